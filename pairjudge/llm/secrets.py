"""Secret scanning with character Markov models, in DataFrame functions only.

Fixed rules give the base spans: ``assign`` (keyword, separator, value), ``access`` and ``hex``. The
models add ``markov`` spans: two first-order character models, one of random strings and one of
ordinary identifiers, are trained from labelled samples, and a token whose log-likelihood ratio
(random against ordinary) reaches ``RATE`` for each of its pairs of characters is a secret. Tokens are runs of ``[A-Za-z0-9+/_=-]`` of
``TOKEN`` characters or more, at least one of them a letter (numbers alone are no secrets); of those that a base span
takes whole there is no second span, but a token with a base span inside is scored whole and may overlap it.

Labelled samples: of the ``SAMPLE`` documents with the smallest hashes of their ids, the words are
ordinary identifiers and the digests of the ids, written in hex, base64 and upper-case base32-like
letters, are random strings. Both counts are smoothed by one per pair of characters, so a model
exists for an empty table as well.

Spans are kind:start:end in code points, end exclusive, ordered by start and then by kind as listed.

Defined results: a null text is empty; rows are scanned one by one, so repeated rows each get their
own result; the text is never cut. All work on a text is linear in its length: positions are running
sums over its matches, in blocks of ``BLOCK``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_PREFIX = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = 12
#: A maximal run of token characters.
TOKEN_RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN},}}+"
KINDS = ("assign", "access", "hex", "markov")

#: Log-likelihood ratio (nats) for each pair of neighbouring characters, from which a token counts as random.
RATE = 0.5
#: Documents whose words and ids are the labelled samples.
SAMPLE = 2000
#: Matches whose positions are summed at a time.
BLOCK = 256


def find(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds a column for each name: leftmost non-overlapping matches, an array of (start, end, match).

    Step by step, so that each step reads what the one before has made instead of matching again."""
    names = list(patterns)
    none = F.array().cast("array<string>")
    has = {k: F.col(text).rlike(p) for k, p in patterns.items()}
    df = df.withColumns({f"__m_{k}": F.when(has[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    # The text before, between and after the matches; with them, lengths give the positions.
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    df = df.withColumns({f"__l_{k}": F.zip_with(F.slice(f"__g_{k}", 1, F.size(f"__m_{k}")), f"__m_{k}",
                                                lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))) for k in names})
    df = df.withColumns({f"__b_{k}": _blocks(F.col(f"__l_{k}")) for k in names})
    df = df.withColumns({f"__t_{k}": F.transform(f"__b_{k}", lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["own"])) for k in names})
    df = df.withColumns({f"__f_{k}": _running(F.col(f"__t_{k}"), F.lit(0), lambda a, t: a, lambda a, t: a + t) for k in names})
    df = df.withColumns({f"__s_{k}": F.flatten(F.zip_with(f"__b_{k}", f"__f_{k}", lambda b, at: _running(
        b, at, lambda a, x: a + x["gap"], lambda a, x: a + x["gap"] + x["own"]))) for k in names})
    df = df.withColumns({k: F.zip_with(f"__s_{k}", f"__m_{k}", lambda s, m: F.struct(
        s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match"))) for k in names})
    return df.drop(*[f"__{x}_{k}" for x in "mglbtfs" for k in names])


def _blocks(items: Column) -> Column:
    empty = F.array().cast("array<array<struct<gap:int,own:int>>>")
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(empty)


def _running(items: Column, begin: Column, shown, after) -> Column:
    """Array of ``shown`` over a running total that ``after`` carries on; for a block's worth of items."""
    start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(items, start, lambda a, x: F.struct(after(a["at"], x).alias("at"), F.concat(a["all"], F.array(shown(a["at"], x))).alias("all")),
                       lambda a: a["all"])


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def samples(documents: DataFrame, n: int = SAMPLE) -> DataFrame:
    """Labelled samples: string, random (true or false), from ``n`` documents."""
    ids = documents.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = documents.join(F.broadcast(ids), documents["doc_id"] == F.col("__id"), "left_semi")  # n ids
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z0-9+/_=-]+"), lambda w: ~w.rlike(f"{HEX}|{ACCESS}") & (F.length(w) > 0))
    ordinary = chosen.select(F.explode(words).alias("string"), F.lit(False).alias("random"))
    digest = F.sha2(F.col("__id").cast("string"), 256)
    letters = F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "XYZ")
    random = ids.select(F.explode(F.array(digest, F.base64(F.unhex(digest)), letters)).alias("string"), F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def model(labelled: DataFrame) -> DataFrame:
    """One row, ``ratios``: log P(b | a, random) - log P(b | a, ordinary) at 128 * ascii(a) + ascii(b) + 1."""
    spark = labelled.sparkSession
    alphabet = spark.range(128).where(F.char("id").rlike("[A-Za-z0-9+/_=-]")).select(F.col("id").cast("int").alias("c"))
    chars = F.filter(F.split("string", ""), lambda c: F.length(c) > 0)
    pairs = (labelled.groupBy("string", "random").agg(F.count(F.lit(1)).alias("n")).withColumn("chars", chars)
             .where(F.size("chars") > 1)
             .select("random", "n", F.explode(F.zip_with(F.slice("chars", 1, F.size("chars") - 1), F.slice("chars", 2, F.size("chars") - 1),
                                                         lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("p"))
             .groupBy("p.a", "p.b").agg(F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("r"),
                                        F.sum(F.when(F.col("random"), 0).otherwise(F.col("n"))).alias("o")))
    # 67 x 67 pairs, each counted once more than it was seen
    every = alphabet.select(F.col("c").alias("a"), F.explode(F.array(*[F.lit(i) for i in range(128) if chr(i).isalnum() or chr(i) in "+/_=-"])).alias("b"))
    counts = every.join(pairs, ["a", "b"], "left").select("a", "b", (F.coalesce("r", F.lit(0)) + 1).alias("r"), (F.coalesce("o", F.lit(0)) + 1).alias("o"))
    sums = counts.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    cells = counts.join(sums, "a").select((F.col("a") * 128 + F.col("b")).alias("at"), (F.log(F.col("r") / F.col("rs")) - F.log(F.col("o") / F.col("os"))).alias("ratio"))
    table = F.map_from_entries(F.collect_list(F.struct("at", "ratio")))  # 67 x 67 cells
    return cells.agg(table.alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(128 * 128 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("ratios"))


def ratio(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a token."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c))
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(ratios, a * 128 + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def scan(documents: DataFrame, train: DataFrame | None = None, rate: float = RATE) -> DataFrame:
    """Adds ``secrets`` to each row of ``documents``: a struct of assign, access, hex, markov (arrays of
    start, end, match), base and spans (as written); a column of that name is replaced, others stay whatever their names. ``train``: documents
    to train on, these unless given."""
    fitted = model(samples((documents if train is None else train).select("doc_id", "text")))
    columns = documents.columns
    # The row as one struct, so that no column of it meets one of the steps below.
    read = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    read = find(read, "__text", {"__assign": ASSIGN, "__access": ACCESS, "__hex": HEX, "__token": f"{ASSIGN}|{TOKEN_RUN}"})
    read = read.withColumns({
        "__assign": F.filter("__assign", lambda s: F.length(F.regexp_replace(s["match"], ASSIGN_PREFIX, "")) >= ASSIGN_VALUE),
        # Base assignments are matched in the tokens' pass too, so that what they take is no token.
        "__token": F.filter("__token", lambda s: s["match"].rlike("[A-Za-z]") & ~s["match"].rlike(f"^{ASSIGN}|^(?:{ACCESS}|{HEX})$"))})
    # A scalar subquery of 16,384 numbers, read by the rows that have tokens.
    read = read.withColumn("__r", F.when(F.size("__token") > 0, fitted.select("ratios").scalar()))
    read = read.withColumn("__markov", F.when(F.size("__token") > 0, F.filter("__token", lambda s: ratio(s["match"], F.col("__r")) >= rate * (F.length(s["match"]) - 1)))
                           .otherwise(F.col("__token")))
    read = read.withColumn("__base", F.concat(*[_named(F.col(f"__{k}"), k) for k in KINDS[:3]]))
    read = read.withColumn("__spans", F.concat("__base", _named(F.col("__markov"), "markov")))
    return read.withColumn("secrets", F.struct(
        *[F.col(f"__{k}").alias(k) for k in KINDS], _written(F.col("__base")).alias("base"), _written(F.col("__spans")).alias("spans"))).select(
            *[F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() != "secrets"], "secrets")


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret replaced by ``mark`` (spans that touch or overlap: one mark)
    and n_chars, where there is such a column, counted anew. Rows without secrets stay as they are."""
    columns = documents.columns
    scanned = scan(documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("document"), "doc_id", "text"))
    ordered = F.array_sort(F.concat(*[F.transform(F.col(f"secrets.{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] > a["at"]
        first = (F.size(a["parts"]) == 0) & (s["start"] == 0)
        kept = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(apart | first, F.concat(a["parts"], F.array(kept, F.lit(mark)))).otherwise(a["parts"]).alias("parts"))

    whole = F.aggregate(ordered, start, step, lambda a: F.array_join(F.concat(a["parts"], F.array(F.substring(F.col("text"), a["at"] + 1, F.length("text")))), ""))
    some = F.size(ordered) > 0
    out = scanned.withColumn("text", F.when(some, whole).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(some, F.length("text")).otherwise(F.col("document.n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"document.`{c}`")).alias(c) for c in columns])
