"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beside them every run of token characters is
judged by two character Markov models, one of random strings and one of ordinary
identifiers: where the log-likelihood ratio of the two is high enough, the run is a span
of kind ``random``. Both models are trained here from labelled samples.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table

#: Fixed patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run that may be a key, of any length from 20; shorter ones are words.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Log-likelihood ratio, in nats, from which a run counts as random.
LEAST = 15.0
REDACTED = "[REDACTED]"

#: Words of which the sample of ordinary identifiers is put together.
_WORDS = """account action active address admin agent album amount android answer append apple archive area array article
assign attach author avatar average backup balance banner before begin binary block board border branch browser buffer build button cache
calendar callback cancel center change channel chapter check class client clock close cluster code collection color column command comment
common company compile complete config connect constant contact container content context control cookie copy count country create current
customer data date debug default delete delivery depth description design detail device dialog digest direct directory disable display
document domain download driver dynamic editor element email enable encode encoding engine enter entry error event example execute export
expression extension factory feature field file filter final find first folder follow font footer format forward frame function gallery
generate global graph green group handler hash header height helper hidden history home host icon image import index info input insert
instance integer interface internal item iterator join journal kernel keyboard label language large layout length level library light line
link list listener load local location logger login machine main manager map margin market master match matrix maximum media member memory
menu merge message method minimum mobile mode model module monitor mouse movie name native network node normal notification number object
offset online open operation option order origin output owner package page panel parameter parent parser partner path pattern payment
percent person phone picture pixel platform player plugin point policy popular position post power preview price print private process
product profile program project property protocol provider public purchase query queue quick random range reader record refresh region
register release remote remove render repeat replace report request reset resource response result return review right router rule runtime
sample save scale schedule schema scope screen script scroll search second section select sender sequence server service session setting
shadow share shipping shop simple single size snapshot social software source space special standard start state static status storage store
stream string style submit subject summary support switch symbol system table target task team template terminal test text theme thread
thumbnail ticket time title toggle tool topic total track traffic transfer transform translate tree trigger type unit universal unknown
update upload user utility validate value variable vector vendor version vertical video view visible visit volume warning watch weather
website weight widget width window wizard worker wrapper write year zone the and that with this from they have were their which other there
because through between without another understanding nevertheless something international responsibility characteristic administration""".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``(text, label)``: ``n`` random strings (1) in several alphabets and ``n`` identifiers (0), by a fixed rule."""
    words = F.array(*map(F.lit, _WORDS))
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(_WORDS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.substring(F.translate(base64, "+/=", ""), 1, 36)).when(F.col("id") % 4 == 2, base64).otherwise(F.substring(F.upper(F.translate(base64, "+/=", "")), 1, 24))
    a, b, c, d = pick(1), pick(2), pick(3), pick(4)
    plain = (
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", a, b, c))
        .when(F.col("id") % 6 == 1, F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)))
        .when(F.col("id") % 6 == 2, F.concat_ws("-", a, b, c))
        .when(F.col("id") % 6 == 3, F.concat_ws("/", a, b, c, d))
        .when(F.col("id") % 6 == 4, F.upper(F.concat_ws("_", a, b, c)))
        .otherwise(F.concat(a, b, c, (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string")))
    )
    ids = spark.range(0, n, 1, 1)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def ratio_table(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of ALPHABET characters, as rows of one list."""
    k = len(ALPHABET)
    chars = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = (
        samples.select("label", F.filter(chars, lambda c: c >= 0).alias("c"))
        .select("label", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("x"), F.expr("slice(c, 2, size(c) - 1)").alias("y"))).alias("p"))
        .groupBy("label", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
        .count()
        .collect()
    )  # at most 2 x 67 x 67 rows
    counts = [[[smooth] * k for _ in range(k)] for _ in range(2)]
    for r in pairs:
        counts[r["label"]][r["x"]][r["y"]] += r["count"]
    return [log(counts[1][x][y] / sum(counts[1][x])) - log(counts[0][x][y] / sum(counts[0][x])) for x in range(k) for y in range(k)]


def _spans(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """SQL for the code point spans of a pattern's matches; ``keep`` judges a match ``$``.

    Splitting at the pattern gives the texts between the matches, and so the places.
    """
    p = _quoted(pattern)
    return f"""
      aggregate(
        zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (b, m) -> named_struct('b', length(b), 'm', m)),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,k:int,e:int>>)),
        (a, x) -> if(x.m is null, a, named_struct('at', a.at + x.b + length(x.m),
          'out', if({keep.replace('$', 'x.m')}, concat(a.out, array(named_struct('s', a.at + x.b, 'k', {kind}, 'e', a.at + x.b + length(x.m)))), a.out))),
        a -> a.out)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _score(run: str, ratios: str) -> str:
    """SQL for the log-likelihood ratio of a run of ALPHABET characters."""
    place = f"(instr({_quoted(ALPHABET)}, c) - 1)"
    k = len(ALPHABET)
    return f"""
      aggregate(split({run}, ''), named_struct('p', -1, 'v', 0D),
        (a, c) -> named_struct('p', if(c = '', a.p, {place}), 'v', if(c = '' or a.p < 0, a.v, a.v + element_at({ratios}, a.p * {k} + {place} + 1))),
        a -> a.v)"""


def with_spans(docs: DataFrame, ratios: list[float], least: float = LEAST) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with more columns, and the names of these: text, the base kinds' spans, base and all spans, by start and kind."""
    table = "cast(split(" + _quoted(",".join(f"{x:.9f}" for x in ratios)) + ", ',') as array<double>)"
    none = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    value = f"length(regexp_extract($, {_quoted(ASSIGN)}, 2)) >= 8"
    own = {c: free_name(f"secret_{c}", docs) for c in ("text", *KINDS, "base", "all")}
    text = f"`{own['text']}`"
    found = docs.withColumn(own["text"], F.coalesce(F.col("text").cast("string"), F.lit("")))
    for k, (p, keep) in enumerate([(ASSIGN, value), (ACCESS, "true"), (HEX, "true")]):
        found = found.withColumn(own[KINDS[k]], F.when(F.regexp_like(text, F.lit(p)), F.expr(_spans(text, p, k, keep))).otherwise(F.expr(none)))
    random = f"exists(regexp_extract_all({text}, {_quoted(RUN)}, 0), t -> {_score('t', table)} >= {least}D)"
    spans = _spans(text, RUN, 3, f"{_score('$', table)} >= {least}D")
    found = found.withColumn(own["random"], F.when(F.expr(random), F.expr(spans)).otherwise(F.expr(none)))
    found = found.withColumn(own["base"], F.array_sort(F.concat(*(f"`{own[c]}`" for c in KINDS[:3]))))
    beyond = F.expr(f"filter(`{own['random']}`, x -> not exists(`{own['base']}`, b -> b.s <= x.s and x.e <= b.e))")
    return found.withColumn(own["all"], F.array_sort(F.concat(f"`{own['base']}`", beyond))), own


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Spans of secrets of every row of ``docs(doc_id, text)``, over the whole text.

    Returns ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)``. Null
    counts as an empty text, which has no spans. Repeated rows repeat, a null doc_id stays
    null, other columns are ignored, an empty table gives no rows. A run that holds a base
    span, or goes on beyond one, adds its whole span; one inside a base span adds nothing.
    """
    ratios = ratio_table(samples if samples is not None else labelled_samples(docs.sparkSession))
    found, own = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios, least)
    return found.select(
        "doc_id",
        *(F.size(own[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(own["base"]), 256).alias("base_sha256"),
        _joined(own["all"]).alias("spans"),
        (F.size(own["all"]) - F.size(own["base"])).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, samples: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """``docs`` with every span of its texts replaced by REDACTED, and n_chars, where there is one, to match.

    Spans that overlap are replaced together. Null texts stay null.
    """
    ratios = ratio_table(samples if samples is not None else labelled_samples(docs.sparkSession))
    found, own = with_spans(docs, ratios, least)
    text, spans = f"`{own['text']}`", f"`{own['all']}`"
    clean = F.expr(f"""
      aggregate({spans}, named_struct('at', 0, 'out', ''),
        (a, x) -> named_struct('at', greatest(a.at, x.e),
          'out', if(x.s >= a.at, concat(a.out, substring({text}, a.at + 1, x.s - a.at), '{REDACTED}'), a.out)),
        a -> concat(a.out, substring({text}, a.at + 1)))""")
    hit = F.size(spans) > 0
    done = free_name("secret_clean", found)
    found = found.withColumn(done, F.when(hit, clean).otherwise(F.col("text")))
    columns = {"text": F.col(done)} | ({"n_chars": F.when(hit, F.length(done).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
