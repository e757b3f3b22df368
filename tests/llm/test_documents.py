"""Near copies, shards, toxicity and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from logtrawl.llm import queries, shards, signature_join, toxicity
from logtrawl.llm.common import staged

from .conftest import DATA


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows):
    """``(n, component)`` of each row, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent, holders = list(range(len(rows))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in holders[s]).items():
            if 100 * common >= 75 * (len(own) + len(sets[j]) - common):
                parent[root(i)] = root(j)
        for s in own:
            holders[s].append(i)
    first = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        first[r] = d if first.get(r) is None else min(x for x in (first[r], d) if x is not None)
    return [(d, len(sets[i]), first[root(i)]) for i, (d, _) in enumerate(rows)], [root(i) for i in range(len(rows))]


def test_linked_groups(spark, odd_docs, empty_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = sorted(map(str, plain_groups(rows)[0]))
    assert sorted(str(tuple(r)) for r in signature_join.linked_groups(odd_docs).collect()) == want
    assert signature_join.linked_groups(empty_docs).count() == 0
    monkeypatch.setattr(signature_join, "CHUNK_NODES", 4)  # groups in chunks
    monkeypatch.setattr(signature_join, "HELD", 300)
    assert sorted(str(tuple(r)) for r in signature_join.linked_groups(odd_docs).collect()) == want


def test_heavy_shingles(spark, monkeypatch):
    """No task is dealt all nodes of a shingle that many share, and the members are the same as if it were."""
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        if i % 3:
            words = [f"u{i}x{j}" for j in range(rnd.randrange(5, 60))]
        else:
            words = [f"w{j}" for j in range(rnd.choice([20, 50, 54, 58, 120]))]
            words[rnd.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = staged(docs.select("text"), "test-texts")
    found, prefix_rows = [], []
    for limit in (signature_join.HEAVY, 15):
        monkeypatch.setattr(signature_join, "HEAVY", limit)
        hot, heavy = signature_join._hot(signature_join._sets(docs.selectExpr("doc_id", "text", "xxhash64(text) as text_key"), 5))
        prefixes = signature_join._prefixes(texts, hot, heavy, 3, 5, 75, 100)
        times = Counter()
        for r in prefixes.collect():
            used, count = np.frombuffer(r.packed, np.int64, 2).tolist()
            times.update(np.frombuffer(r.packed, np.uint64, count, 16 + 16 * used).tolist())
        prefix_rows.append(max(times.values()))
        met = signature_join._heavy_met(texts, hot, heavy, 5, 75, 100) if len(heavy) else None
        found.append(sorted(map(tuple, signature_join._members(prefixes, 3, 75, 100, met).collect())))
    assert prefix_rows[0] > 30 > prefix_rows[1] and found[0] == found[1]
    assert sorted(map(tuple, signature_join.linked_groups(docs).collect())) == sorted(plain_groups(rows)[0])


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_signature_trees(spark, DATA).collect())) == sorted(plain_groups(rows)[0])


def test_chains_reach_the_smallest(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "node long, other long")
    got = {r.node: r.label for r in signature_join.components(edges).collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 200: 100, 300: 100}


def test_trees():
    rnd = random.Random(5)
    for _ in range(60):
        base = [rnd.getrandbits(64) for _ in range(rnd.choice([5, 30, 200]))]
        sets = []
        for _ in range(rnd.randrange(2, 50)):
            x = [t for t in base if rnd.random() > rnd.choice([0, 0.05, 0.12, 0.3])] + [rnd.getrandbits(64) for _ in range(rnd.randrange(0, 20))]
            sets.append(np.array(sorted(set(x)) or [1], np.uint64))
        cut = rnd.choice([None, len(sets) // 2]) if len(sets) > 3 else None
        parent, links = list(range(len(sets))), np.zeros(len(sets), bool)

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if (cut is None or (i < cut) != (j < cut)) and signature_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    links[i] = links[j] = True
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        got = signature_join.tree_join(sets if cut is None else sets[:cut], None if cut is None else sets[cut:])
        assert got.tolist() == [root(i) for i in range(len(sets))]
        maps = [signature_join.bitmap(x, signature_join._width(len(x))) for x in sets]
        may = signature_join.may_link(np.array([len(x) for x in sets]), maps, None if cut is None else np.arange(len(sets)) < cut)
        assert not (links & ~may).any()


def test_one_of_each_group(odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    _, roots = plain_groups(rows)
    worded = {roots[i] for i, (_, t) in enumerate(rows) if shingles(t)}
    got = signature_join.one_of_each_group(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [r for r in got.collect() if shingles(r.text)]
    assert len(kept) == len(worded)
    assert got.count() - len(kept) == sum(not shingles(t) for _, t in rows)
    assert signature_join.one_of_each_group(empty_docs).count() == 0


def test_shards(spark, odd_docs, empty_docs):
    for docs, count in ((spark.read.parquet(f"{DATA}/documents.parquet"), 40), (odd_docs, 7), (empty_docs, 3)):
        rows = docs.select("doc_id", "text").collect()
        got = shards.byte_shards(docs, count).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        held = defaultdict(list)
        for r in got:
            held[r.shard].append(r)
        largest, total = max((r["size"] for r in got), default=0), sum(r["size"] for r in got)
        for own in held.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / count) <= largest
        order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)


def test_clauses_not_words():
    grammar = toxicity.Grammar({"idiot": 4.0, "trash$": 3.0})
    plain, aimed, denied, told = (grammar.clause(t)[0] for t in ("what an idiot", "you are an idiot", "not an idiot", 'he said "what an idiot"'))
    assert aimed > plain > told > 0 and plain > denied > 0
    assert grammar.clause("i will kill you")[0] < grammar.clause("you know i will kill them")[0]
    assert grammar.clause("trashes")[0] == 0 and grammar.clause("idiotic")[0] > 0
    assert grammar.features("") == grammar.features("nothing here") == (0.0,) * 5
    assert grammar.features("such an idiot. " * 3)[3] > grammar.features("such an idiot.")[3]
    long = "a " * 200_000 + "idiot" + " b" * 200_000
    assert grammar.features(long)[0] > 0


def test_clauses_of_unspaced_texts():
    """Without blanks and end marks a clause has at most CLAUSE characters before its match, whole words only."""
    grammar, seen = toxicity.Grammar({"idiot": 4.0}), []
    clause = grammar.clause
    grammar.clause = lambda text: seen.append(text) or clause(text)
    part = "字" * 5 + "。" + "x" * 5 + "-idiot" + "-" * 2 * toxicity.CLAUSE
    once, often = grammar.features(part), grammar.features(part * 40)
    assert len(seen) == 41 and max(map(len, seen)) <= 2 * toxicity.CLAUSE + len("idiot")
    assert often[0] == pytest.approx(np.log1p(40 * np.expm1(once[0]))) and often[2] == once[2]
    seen.clear()
    grammar.features("!" + "字、" * 200 + "y" * 10 + "idiot" + "-" * 297 + "、idiot")
    assert not any(text.startswith("idiot") for text in seen if text != "idiot")


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op1_clause_grammar(spark, sf_dir).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p and y for p, y in judged)
    assert hits / sum(y for _, y in judged) >= 0.85 and hits / sum(p for p, _ in judged) >= 0.9


def test_toxicity_of_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2 if i > 5 else None) for i in range(40)] + [(None, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.score(odd_docs, labels.filter("false")).filter("_toxic_score is null").count() == 0
    assert toxicity.without_toxic(empty_docs, labels).columns == odd_docs.columns


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, DATA)
    rejected = {r.doc_id for r in queries.op1_clause_grammar(spark, DATA).collect() if r.predicted}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected
    single = corpus_pipeline.drop_near_copies(spark, clean, DATA)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in plain_groups([(r.doc_id, r.text) for r in clean.collect()])[0]})
    masked = corpus_pipeline.mask_secrets(spark, single, DATA)
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert all(r.n_chars == len(r.text) for r in masked.filter("contains(text, '[secret]')").collect())
    out = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in single.collect()}


@pytest.mark.parametrize("which", range(4))
def test_stages_take_odd_and_empty_tables(spark, odd_docs, empty_docs, which):
    name, stage = corpus_pipeline.STAGES[which]
    for docs in (odd_docs, empty_docs):
        out = stage(spark, docs, DATA)
        assert out.count() >= 0 and (which == 3 or out.columns == docs.columns)
