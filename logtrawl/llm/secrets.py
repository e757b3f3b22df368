"""Secret scan with corpus-wide ownership frequency, in SQL functions only.

Candidates are found in whole texts and hashed. Each hash is counted over all documents by distinct owners: a value that
looks random is a live credential while fewer than ``WIDE_OWNERS`` owners hold it in texts of their own, and a widely
copied example from there on. Whole copies of a text count for one owner there, the smallest that has it, so that copying
a document settles nothing. A value that does not look random is never live; it is copied once ``WIDE_OWNERS`` owners hold it,
in copies or not. Counts are aggregated in steps (value, owner, repository; value, owner; value, and value, text; value,
owner; value), each with partial sums before its shuffle, and go back to the candidates by an ordinary join whose hot
values Spark splits. Repositories are counted but take no part in the verdict.

Base kinds: ``assign`` (a named value of eight characters or more), ``access`` and ``hex``. The method's own kind is ``owned``: a
longer random-looking token outside the base spans that is live. Null texts are empty; a null owner or
repository counts as one of its own; repeated rows count once per owner and repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .native_spans import joined, literal, with_spans

# fixed patterns of the base kinds; the letters of a name are in either case
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex")
WIDE_OWNERS = 3
MASK = "[secret]"


def _value(kind: str) -> str:
    return f"regexp_extract(s.value, {literal(ASSIGN)}, 1)" if kind == "assign" else "s.value"


def _random_looking(value: str, named: bool = False) -> str:
    """A named value may be short or without digits: half as many distinct characters as it is long are enough, ten at most,
    and for a digit stands that upper and lower case change more often than where words are put together."""
    distinct = f"least(10, char_length({value}) / 2)" if named else "10"
    changes = f"size(split({value}, '(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])', -1)) - 1"
    mixed = f"({value} rlike '[0-9]' or 3 * ({changes}) >= char_length({value}))" if named else f"{value} rlike '[0-9]'"
    return f"({mixed} and {value} rlike '[A-Za-z]' and size(array_distinct(split({value}, ''))) >= {distinct} and not {value} rlike '(?i)example|sample|dummy|changeme|xxxx|0123456789|abcdef01')"


def candidates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``assign, access, hex, token``: arrays of ``start, end, hash, looks`` (random-looking)."""
    df = with_spans(df, text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}, {"access": f"contains({text}, 'AKIA')"})
    keep = {
        "assign": f"char_length({_value('assign')}) >= 8",
        "access": "char_length(s.value) >= 16",
        "hex": "true",
        "token": _random_looking("s.value"),
    }
    df = df.withColumns({k: F.expr(f"filter({k}, s -> {test})") for k, test in keep.items()})
    inside = " or ".join(f"exists({k}, b -> b.start < s.end and s.start < b.end)" for k in KINDS)
    df = df.withColumn("token", F.expr(f"filter(token, s -> not ({inside}))"))
    form = "transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'hash', xxhash64({v}), 'looks', {l}))"
    return df.withColumns({k: F.expr(form.format(k=k, v=_value(k), l=_random_looking(_value(k), k == "assign"))) for k in (*KINDS, "token")})


def ownership(occurrences: DataFrame) -> DataFrame:
    """``hash, holders, repositories, occurrences, owners, looks`` from one row per occurrence (``hash, owner, repository,
    text_key, looks``): ``holders`` are all distinct owners, ``owners`` those of distinct texts, one for each text."""
    first = occurrences.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    second = first.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    held = second.groupBy("hash").agg(F.count("*").alias("holders"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))
    texts = occurrences.groupBy("hash", "text_key").agg(F.min("owner").alias("owner"), F.max("looks").alias("looks"))
    own = texts.groupBy("hash", "owner").agg(F.max("looks").alias("looks")).groupBy("hash").agg(F.count("*").alias("owners"), F.max("looks").alias("looks"))
    return held.join(own, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied, live`` and
    ``text_key``. ``repository`` is distinct within its owner. ``live`` are the hashes of the live-looking values,
    ``n_live`` and ``n_copied`` count the candidates so judged."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        whole_text(text_col).alias("text"),
        F.xxhash64(whole_text(text_col)).alias("text_key"),
    )
    rows = staged(candidates(rows, "text").drop("text"), "secret-candidates")
    every = "concat(assign, access, hex, token)"
    found = rows.filter(f"size({every}) > 0").selectExpr("row", "owner", "repository", "text_key", f"explode(array_distinct(transform({every}, s -> struct(s.hash as hash, s.looks as looks)))) as c")
    found = found.select("row", "owner", "repository", "text_key", "c.hash", "c.looks")
    counts = staged(ownership(found), "secret-owners")
    alive = F.col("looks") & (F.col("owners") < WIDE_OWNERS)
    judged = found.select("row", "hash").join(counts, "hash").select(
        "row",
        F.when(alive, F.struct("hash")).alias("live"),
        F.when(~alive & (F.col("holders") >= WIDE_OWNERS), F.struct("hash")).alias("copied"),
    )
    verdict = judged.groupBy("row").agg(F.collect_set("live.hash").alias("live"), F.collect_set("copied.hash").alias("copied"))
    rows = rows.join(verdict, "row", "left").withColumns({c: F.expr(f"coalesce({c}, cast(array() as array<long>))") for c in ("live", "copied")})
    rows = rows.withColumn("owned", F.expr("filter(token, s -> array_contains(live, s.hash))"))
    base = {k: k for k in KINDS}
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(base | {"owned": "owned"}).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        *[F.expr(f"cast(size(filter({every}, s -> array_contains({c}, s.hash))) as long)").alias(f"n_{c}") for c in ("live", "copied")],
        "live",
        "text_key",
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "lang", length_col: str | None = None) -> DataFrame:
    """``docs`` with the live-looking values in their texts replaced by ``MASK``; all rows and all else stay, but for
    ``length_col``, the length of the text.

    Live hashes belong to a text wherever it stands, so they come back by the hash of the text."""
    live = scan(docs, id_col, text_col, owner, repository).filter("n_live > 0")
    live = live.select(F.col("text_key").alias("_secret_key"), F.explode("live").alias("_secret_hash")).distinct()
    live = staged(live.groupBy("_secret_key").agg(F.collect_set("_secret_hash").alias("_secret_live")), "secret-live")
    keyed = docs.withColumn("_secret_key", F.xxhash64(whole_text(text_col)))
    out = keyed.join(live, "_secret_key", "left").withColumn("_secret_text", F.col(text_col))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        value = _value(kind).replace("s.value", "m")
        swap = f"if(array_contains(_secret_live, xxhash64({value})), concat(left(m, char_length(m) - char_length({value})), '{MASK}'), m)"
        out = out.withColumn("_secret_cut", F.expr(f"if(_secret_live is null, null, split(_secret_text, {literal(pattern)}, -1))"))
        hits = f"regexp_extract_all(_secret_text, {literal(pattern)}, 0)"
        again = f"concat(element_at(_secret_cut, 1), array_join(zip_with(slice(_secret_cut, 2, size(_secret_cut)), {hits}, (g, m) -> concat({swap}, g)), ''))"
        out = out.withColumn("_secret_text", F.expr(f"if(_secret_live is null, _secret_text, {again})"))
    names = {text_col: "_secret_text"} | ({length_col: f"if(_secret_live is null, `{length_col}`, char_length(_secret_text))"} if length_col else {})
    return out.select(*[F.expr(names[c]).cast(docs.schema[c].dataType).alias(c) if c in names else F.col(c) for c in docs.columns])
