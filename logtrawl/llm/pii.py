"""Personal data by weak supervision, in SQL functions only.

Patterns propose spans in whole texts. Labelers vote on each: the strict form of its kind, its layout, gazetteers (calling codes,
card issuers, mail endings, address ranges), and cue words in its context. Expectation-maximisation over the counts of vote patterns
estimates how often each labeler is right, without any labels; its posteriors train a logistic classifier on span
features, which decides about the proposals that the base kinds do not hold already.

Only counts by vote and feature pattern come to the driver: at most ``len(KINDS) * 3 ** labelers`` rows for the first,
and that times the few feature values for the second, whatever the corpus. Everything else stays in its row.

Base kinds ``email, ip, card, phone`` always stay; the method adds ``contact`` (local telephone forms) and ``number`` (long
account or card numbers that fail the checksum). Null texts are empty and have no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .native_spans import joined, with_spans

# fixed patterns of the base kinds. They take the same texts as the plain forms, without backtracking into a run; a run of
# the first class that is entered in its middle only counts behind a match
_START = r"(?:\G|(?<![{0}]))"
EMAIL = _START.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _START.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CONTACT = r"(?<![0-9+A-Za-z(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "contact", "number")
CONTEXT = 40
CUES = "mail|contact|write|reach|call|phone|tel|fax|mobile|card|visa|account|iban|pay|server|host|login|address|ip"
AGAINST = "version|isbn|figure|page|order no|serial|sku|price|total|chapter"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|39|41|43|44|45|46|47|48|49|52|55|61|62|81|82|86|90|91"
MAIL_ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
LABELERS = ("strict", "layout", "gazetteer", "context")
FEATURES = ("kind", "digits", "length", "before", "after")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """The checksum of a string of digits: every second one from the right is doubled, its digits summed."""
    number = f"transform(split(reverse({digits}), ''), (c, i) -> cast(c as int) * (1 + i % 2))"
    return f"aggregate({number}, 0, (sum, d) -> sum + if(d > 9, d - 9, d)) % 10 = 0"


def _base(kind: str) -> str:
    """SQL test that a match of the base pattern counts."""
    digits = _digits("s.value")
    return {
        "email": "true",
        "ip": "forall(split(s.value, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255 and (char_length(p) <= 3 or ltrim('0', p) = '' or cast(ltrim('0', p) as int) <= 255))",
        "card": f"char_length({digits}) between 14 and 19 and s.value rlike '[0-9].*[0-9]' and {_luhn(digits)}",
        "phone": f"char_length({digits}) between 10 and 15",
    }[kind]


def proposals(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the base kinds and ``contact``, ``number`` as arrays of spans."""
    has_digit = f"{text} rlike '[0-9]'"
    tests = {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')", "ip": has_digit, "card": has_digit, "contact": has_digit}
    df = with_spans(df, text, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "contact": CONTACT}, tests)
    digits = _digits("s.value")
    # a number is a card form of a card's length that is none
    df = df.withColumn("number", F.expr(f"filter(card, s -> char_length({digits}) between 13 and 19 and not (char_length({digits}) >= 14 and {_luhn(digits)}))"))
    df = df.withColumns({k: F.expr(f"filter({k}, s -> {_base(k)})") for k in BASE})
    inside = " or ".join(f"exists({k}, b -> b.start < s.end and s.start < b.end)" for k in BASE)
    return df.withColumns({k: F.expr(f"filter({k}, s -> not ({inside}))") for k in ("contact", "number")})


def voted(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``spans``: all proposals with their votes (1, 0 abstains, -1) and features."""
    digits = _digits("s.value")
    before = f"lower(substring({text}, cast(greatest(s.start - {CONTEXT}, 0) + 1 as int), cast(least(s.start, {CONTEXT}) as int)))"
    after = f"substring({text}, cast(s.end + 1 as int), 1)"
    gazetteer = {
        "email": f"if(lower(s.value) rlike '[.]({MAIL_ENDINGS})$', 1, -1)",
        "ip": "if(s.value rlike '^(0|10|127|169[.]254|192[.]168|22[4-9]|2[3-5][0-9])[.]', -1, 1)",
        "card": f"if({digits} rlike '^(4|5[1-5]|34|37|6011|65)', 1, -1)",
        "phone": f"if({digits} rlike '^({CALLING_CODES})', 1, -1)",
        "contact": f"if({digits} rlike '^[2-9]', 1, -1)",
        "number": f"if({digits} rlike '^(4|5[1-5]|34|37|6011|65)', 1, -1)",
    }
    layout = {
        "email": "if(s.value rlike '^[.%+-]|[.][.]', -1, 1)",
        "ip": "if(s.value rlike '(^|[.])0[0-9]', -1, 1)",
        "card": f"if(s.value rlike '^[0-9]{{4}}([ -][0-9]{{4}})+', 1, if(char_length({digits}) = 16, 0, -1))",
        "phone": "if(s.value rlike '[ ().-]', 1, 0)",
        "contact": "if(s.value rlike '[(]', 1, 0)",
        "number": f"if(s.value rlike '^[0-9]{{4}}([ -][0-9]{{4}})+', 1, if(char_length({digits}) = 16, 0, -1))",
    }
    parts = []
    for i, k in enumerate(KINDS):
        strict = "1" if k in BASE else ("-1" if k == "number" else "0")
        parts.append(
            f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', {i}, 'strict', {strict}, 'layout', {layout[k]}, 'gazetteer', {gazetteer[k]}, "
            f"'context', if({before} rlike '\\\\b({AGAINST})\\\\b', -1, if({before} rlike '\\\\b({CUES})\\\\b', 1, 0)), "
            f"'digits', cast(least(char_length({digits}), 20) as int), 'length', cast(least(ceil((s.end - s.start) / 4), 10) as int), "
            f"'before', case when {before} = '' then 0 when {before} rlike '[ ]$' then 1 when {before} rlike '[:=(<]$' then 2 when {before} rlike '[a-z0-9]$' then 3 else 4 end, "
            f"'after', case when {after} = '' then 0 when {after} rlike '[ .,;)\\\\n]' then 1 when {after} rlike '[A-Za-z0-9]' then 3 else 4 end))"
        )
    return df.withColumn("spans", F.expr("concat(" + ", ".join(parts) + ")"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict]:
    """EM over ``(votes, count)``: the share of true spans, each labeler's rates of +1 among its votes on true and on
    false spans, and the posterior of each vote pattern. Counts are smoothed, so unseen votes and empty tables are safe."""
    prior, rates = 0.5, [(0.8, 0.2)] * len(LABELERS)
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (yes, no) in zip(votes, rates, strict=True):
                odds += 0 if v == 0 else math.log(yes / no) if v > 0 else math.log((1 - yes) / (1 - no))
            posterior[votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        total = sum(n for _, n in patterns)
        prior = (1 + sum(n * posterior[v] for v, n in patterns)) / (2 + total)
        new = []
        for i in range(len(LABELERS)):
            yes = [(n * posterior[v], v[i]) for v, n in patterns if v[i]]
            no = [(n * (1 - posterior[v]), v[i]) for v, n in patterns if v[i]]
            rate = [(prior_hits + sum(w for w, s in side if s > 0)) / (10 + sum(w for w, _ in side)) for side, prior_hits in ((yes, 8), (no, 2))]
            new.append((rate[0], rate[1]))
        rates = new
    return prior, rates, posterior


def train(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 300, step: float = 1.0, ridge: float = 1e-3) -> dict[tuple[int, int], float]:
    """Weights of one-hot features from ``(features, share of true spans, count)`` by gradient steps; key (-1, 0) is the bias."""
    weights: dict[tuple[int, int], float] = {(-1, 0): 0.0}
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        slope = {k: ridge * w for k, w in weights.items()}
        for features, target, n in rows:
            keys = [(-1, 0), *enumerate(features)]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights.get(k, 0.0) for k in keys)))))
            for k in keys:
                slope[k] = slope.get(k, 0.0) + (p - target) * n / total
        for k, g in slope.items():
            weights[k] = weights.get(k, 0.0) - step * g
    return weights


def _score(weights: dict[tuple[int, int], float]) -> str:
    """SQL for the log odds of a span ``s``."""
    terms = [repr(weights[(-1, 0)])]
    for i, name in enumerate(FEATURES):
        cases = " ".join(f"when {v} then {w!r}" for (f, v), w in sorted(weights.items()) if f == i)
        if cases:
            terms.append(f"(case s.{name} {cases} else 0.0 end)")
    return "cast(" + " + ".join(terms) + " as double)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_contact, n_number``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = staged(voted(proposals(rows, "text"), "text").select("doc_id", "spans"), "pii-spans")
    spans = rows.select(F.explode("spans").alias("s")).select("s.*")
    seen = spans.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n"))
    # bounded: kinds x votes x feature values
    counted = [(tuple(r[v] for v in LABELERS), tuple(r[f] for f in FEATURES), r["n"]) for r in seen.collect()]
    by_votes: dict[tuple[int, ...], int] = {}
    for votes, _, n in counted:
        by_votes[votes] = by_votes.get(votes, 0) + n
    posterior = reliabilities(sorted(by_votes.items()))[2]
    by_features: dict[tuple[int, ...], list[float]] = {}
    for votes, features, n in counted:
        entry = by_features.setdefault(features, [0.0, 0])
        entry[0] += n * posterior[votes]
        entry[1] += n
    weights = train([(f, hit / n, n) for f, (hit, n) in sorted(by_features.items())])
    number = {k: i for i, k in enumerate(KINDS)}
    of_kind = {k: f"filter(spans, s -> s.kind = {number[k]}" + (")" if k in BASE else f" and {_score(weights)} >= 0)") for k in KINDS}
    rows = rows.selectExpr("doc_id", *[f"{e} as {k}" for k, e in of_kind.items()])
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined({k: k for k in BASE}).cast("binary"), 256).alias("base_sha256"),
        joined({k: k for k in KINDS}).alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[len(BASE) :]],
    )
