"""Text functions as columns: tokenizers, sentence splitters, times, paths and small helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stopword lists, which differ on purpose.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with "
    "at by from as into through during before after above below between under again further then once here there when where why how all each few more most other "
    "some such no nor not only own same so than too very just and but if or because until while this that these those it its"
).split()
KEYWORD_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from as into "
    "through during before after above below between under again further then once here there when where why how all each few more most other some such no nor "
    "not only own same so than too very just and but if or because until while what which who this that these those i me my myself we our you your he him she "
    "her it its they them their"
).split()
# Course name parts by domain, in order of precedence.
DOMAINS = {
    "aws": "52-weeks-aws aws-cloud-practitioner aws-certified aws-lambda aws-llmops bedrock building-genai-aws amazon- sagemaker".split(),
    "ml": "machine-learning applied-ml pytorch mlops hugging-face data-science deep-learning neural llm advanced-rag genai ai- openai".split(),
    "k8s": "kubernetes docker assimilate-containers container minikube k8s".split(),
    "lang": "rust python assimilate-go golang assimilate-java java- swift julia c-programming cpp javascript typescript".split(),
    "devops": "devops github-actions makefile linux terraform ci-cd ansible jenkins".split(),
    "data": "data-engineering databricks pandas sql snowflake spark etl dbt".split(),
    "cloud": "going-pro-cloud-computing duke-cloud assimilate-azure assimilate-google gcp azure".split(),
}
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
WHITE = r"(?U)\s+"


def stripped(c: Column) -> Column:
    """c without Unicode white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column, stopwords: list[str] | None = None, lowercase: bool = True, least: int = 2) -> Column:
    """Index terms: alphanumeric runs in lower case, without stopwords and terms of under `least` bytes; repeats stay."""
    stop = STOPWORDS if stopwords is None else stopwords
    parts = F.split(F.lower(c) if lowercase else c, NOT_ALNUM)
    kept = lambda w: (F.octet_length(w) >= least) & ~w.isin(stop) if stop else F.octet_length(w) >= least
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), kept)


def keywords(c: Column) -> Column:
    """Query keywords: three bytes and more, without the keyword stopwords."""
    return tokens(c, KEYWORD_STOPWORDS, least=3)


def white_tokens(c: Column) -> Column:
    """Lower-case pieces between white space, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WHITE), lambda w: w != "")


def sentences(c: Column, before_capital: bool = True) -> Column:
    """Trimmed non-empty sentences. One ends at . ! or ? before white space or the end of the text and, with
    `before_capital`, before a capital letter."""
    follow = r"(?U)(?<=[.!?])(?=[\s\p{Lu}])" if before_capital else r"(?U)(?<=[.!?])(?=\s)"
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), follow), stripped), lambda s: s != "")


def header(line: Column) -> Column:
    """Text of a Markdown header line, or null."""
    text = F.regexp_extract(line, r"(?U)^\s*#++\s*(\S.*?)\s*$", 1)
    return F.when(text != "", text)


def parse_time(c: Column) -> Column:
    """Seconds of [HH:]MM:SS with , or . before the fraction; null for anything else."""
    p = F.split(stripped(F.regexp_replace(c, ",", ".")), ":")
    num = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, num(1) * 3600 + num(2) * 60 + num(3)).when(F.size(p) == 2, num(1) * 60 + num(2))


def display_time(secs: Column) -> Column:
    """M:SS, or H:MM:SS from an hour up; rounded half up, negative times are zero."""
    n = F.floor(F.greatest(secs, F.lit(0.0)) + 0.5).cast("long")
    h, m, s = F.floor(n / 3600).cast("long"), F.floor((n % 3600) / 60).cast("long"), n % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def srt_time(secs: Column) -> Column:
    """HH:MM:SS,mmm with rounded milliseconds; negative times are zero."""
    n = F.floor(F.greatest(secs, F.lit(0.0)) * 1000 + 0.5).cast("long")
    part = lambda unit, of=None: F.floor(n / unit).cast("long") if of is None else F.floor(n / unit).cast("long") % of
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000), part(60_000, 60), part(1000, 60), n % 1000)


def fts_query(c: Column) -> Column:
    """Each white-space token as a quoted literal, quotes inside dropped; empty tokens go."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), WHITE), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def round4(c: Column) -> Column:
    return F.round(c, 4)


def domain(course: Column) -> Column:
    """The first domain with a part that the course name contains, else `other`."""
    low = F.lower(course)
    hit = lambda parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    out = None
    for name, parts in DOMAINS.items():
        out = F.when(hit(parts), name) if out is None else out.when(hit(parts), name)
    return out.otherwise("other")


def course_dir(path: Column) -> Column:
    """The component after the first `courses` that has one, else the third from the end, else `unknown`."""
    p = F.split(path, "/")
    at = F.array_position(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "courses").cast("int")
    third = F.when(F.size(p) >= 3, F.element_at(p, -3)).otherwise("unknown")
    return F.when(at > 0, F.try_element_at(p, at + 1)).otherwise(third)


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """Lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def frame_time(path: Column) -> Column:
    """Seconds in a `frame_<number>[s]` file name, else null."""
    return F.regexp_extract(file_stem(path), r"^frame_(.*?)s*$", 1).try_cast("double")


def byte_find(text: Column, part: Column) -> Column:
    """Byte offset of the first occurrence of part in text, or null."""
    at = F.position(part, text)
    return F.when(at > 0, F.octet_length(F.substr(text, F.lit(1), at - 1)))
