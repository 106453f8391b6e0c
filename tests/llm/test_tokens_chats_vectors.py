"""Packing, token output, chat formatting, nearest neighbours, the pipeline."""

import os
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_rows import SF
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import checks
import corpus_pipeline
from opinionlake.llm import ann, chat_format, packing, registry, token_output, tokens


def plain_ids(text):
    return tokens._tokenizer(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens -------------------------------------------------------------------


def test_cached_ids_equal_the_tokenizer(monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["", " ", "a  b", "don't. we'll, go", "<|endoftext|> a <|endoftext|>b", "a\u0085 b", "한국어 말. 中文,字 。", "²³ ½."]
    texts += ["".join(rng.choice(" \n\t.,aé　 \x1c!'s1한×<") for _ in range(rng.randrange(70))) for _ in range(1500)]
    texts.append(" ".join(texts[:200]) * 3)
    for size, keep in ((tokens.BLOCK, tokens.KEEP), (300, 50)):
        monkeypatch.setattr(tokens, "BLOCK", size)
        monkeypatch.setattr(tokens, "KEEP", keep)
        got = {}
        for rows, ids, per in tokens.Encoder(tokens.default_path()).column(pa.array([*texts, None])):
            at = 0
            for row, n in zip(rows.tolist(), per.tolist(), strict=True):
                got[row] = ids[at : at + n].tolist()
                at += n
        assert [got[i] for i in range(len(texts) + 1)] == [plain_ids(t)[:-1] for t in [*texts, None]]


# --- packing ------------------------------------------------------------------


def check_pieces(rows, texts):
    """Every id in exactly one piece, every sequence gapless and at most 1024 long; returns padded tokens."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids, at = plain_ids(texts[key]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padded += 1024 - at if at & (at - 1) else 0
    return padded, len(by_seq)


def test_packing_keeps_every_id_and_pads_little(spark, docs):
    rows = packing.op4_packing(spark, SF).collect()
    padded, _ = check_pieces(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padded <= 1024 * docs.rdd.getNumPartitions()
    groups = defaultdict(set)
    for r in rows:
        groups[r.step_group].add((r.sequence_id, r.tier))
    assert all(len({t for _, t in g}) == 1 and sum(t for _, t in g) <= 8192 for g in groups.values())


def test_packing_odd_rows(odd, none):
    given = odd.dropDuplicates(["doc_id"])
    rows = packing.pack(given, s=packing.Settings(lot=3)).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, {r.doc_id: r.text for r in given.collect()})
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).agg(F.countDistinct("doc_id")).first()[0] == given.count() - 1


# --- token output -------------------------------------------------------------


def test_later_rounds_look_at_new_symbols_only(monkeypatch):
    rounds, frequent = [], token_output._frequent
    monkeypatch.setattr(token_output, "_frequent", lambda codes, least: (rounds.append(codes), frequent(codes, least))[1])
    words = np.random.default_rng(5).integers(1, 300, (400, 4))
    ids = words[np.random.default_rng(6).integers(0, 400, 9000)].ravel().astype(np.uint32)
    ids[::7] = np.random.default_rng(7).integers(300, 50_000, len(ids[::7]))
    g = token_output.compress(ids, np.arange(0, len(ids), 90), token_output.Settings(least=6))
    assert (token_output.expand(g, g.symbols) == ids).all() and len(rounds) > 2
    new = [(c >> np.uint64(32) >= token_output.ALPHABET) | (c & np.uint64(0xFFFFFFFF) >= token_output.ALPHABET) for c in rounds[1:]]
    assert all(n.all() for n in new)


def test_frequent_codes_that_share_a_slot():
    codes = np.random.default_rng(3).integers(0, 1 << 62, 30_000).astype(np.uint64)
    times = np.random.default_rng(4).integers(1, 9, len(codes))
    line = np.random.default_rng(5).permutation(np.repeat(codes, times))
    found, at, which = token_output._frequent(line, 5)
    assert found.tolist() == sorted(codes[times >= 5].tolist())
    assert (found[which] == line[at]).all() and at.tolist() == np.flatnonzero(np.isin(line, found)).tolist()


def test_a_block_is_looked_up_once(monkeypatch):
    looked, find = [], tokens.Encoder._find
    monkeypatch.setattr(tokens.Encoder, "_find", lambda self, keys: (looked.append(len(keys)), find(self, keys))[1])
    encoder = tokens.Encoder(tokens.default_path(), 30)
    for text in ("a few new words", "a few more new words", " ".join(f"w{i}" for i in range(40))):
        _, ids, _ = next(encoder.column(pa.array([text])))
        assert ids.tolist() == plain_ids(text)[:-1]
    assert len(looked) == 3


@pytest.mark.parametrize("seed", range(3))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 200, 300)
    ids = rng.choice([3, 5, 7, 50_000], int(sizes.sum()), p=[0.5, 0.3, 0.1, 0.1]).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    payload = token_output.dump(np.arange(300), ids, starts, token_output.Settings(least=4))
    shard = token_output.Shard(payload)
    assert (shard.all() == ids).all() and len(shard.grammar.left) > 10 and len(payload) < 4 * len(ids) + 8000
    for i in (0, 17, 299):
        assert (shard.document(i) == ids[starts[i] : starts[i] + sizes[i]]).all()
    for a, b in ((0, 1), (100, 5000), (len(ids) - 3, len(ids))):
        assert (shard.slice(a, b) == ids[a:b]).all()
    assert token_output.lengths_of(shard.grammar).sum() == len(ids)
    with pytest.raises(ValueError):
        token_output.Shard(b"x" * 100)


def expected_output(rows):
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = plain_ids(text)
        out.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_output_reads_back(spark, docs):
    got = token_output.op5_token_output(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == expected_output([(r.doc_id, r.text) for r in docs.collect()])


def test_token_output_odd_rows(spark, odd, none, tmp_path):
    for name, df in (("odd", odd), ("none", none)):
        token_output.write(df, str(tmp_path / name), s=token_output.Settings(shard_ids=500))
        got = token_output.read(spark, str(tmp_path / name)).select(
            "doc_id", "start", (F.octet_length("ids") / 4).cast("long"), F.crc32("ids")
        )
        want = expected_output([(r.doc_id, r.text) for r in df.collect()])
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


# --- chats --------------------------------------------------------------------


def test_chat_equals_sql(spark):
    df = chat_format.op7_chat(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert checks.differences(df, checks.duck(SF), registry.ORACLES["op7_chat"]) == []


def test_tied_turns_are_ordered_by_text(spark, tmp_path):
    texts = ["a!", "a", None, "", "b\"c", "\u00e9", "Z", "<|end|>", "\\", "a\u0000", "a"]
    rows = [(c, t, r, x) for c in (1, None) for t in (0, None) for r in ("user", "assistant", None) for x in texts]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert checks.differences(chat_format.op7_chat(spark, folder), con, registry.ORACLES["op7_chat"]) == []


def test_chat_parts_and_odd_rows(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "look <|end|>"), part("image", ref="i1", units=2), None, part("audio", ref="s", units=3)]),
        (1, 1, "assistant", [part("text", "a\\"), part("text", "b<"), part("film", ref="f", units=1)]),
        (1, 1, "assistant", [part("text", "a\\"), part("text", "b<"), part("film", ref="f", units=1)]),
        (1, None, "<|turn|>", [part("text", "first")]),
        (None, 5, None, None),
        (2, 0, "assistant", [part("text", None)]),
    ]
    schema = f"conv_id long, turn long, role string, parts {chat_format.PARTS}, formatted string, position long"
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], schema)
    got = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    one = got[1]
    assert [(t.role, t.text, t.learned) for t in one.turns] == [
        ("<|turn|>", "first", False),
        ("user", "look <|end|><|image:1|><|audio:2|>", False),
        ("assistant", "a\\b<<|document:3|>", True),
        ("assistant", "a\\b<<|document:4|>", True),
    ]
    assert [(a.number, a.kind, a.ref, a.position, a.tokens) for a in one.attachments] == [
        (1, "image", "i1", 1, 512), (2, "audio", "s", 1, 75), (3, "document", "f", 2, 600), (4, "document", "f", 3, 600),
    ]
    spans = [one.formatted[s.start : s.start + s.length] for s in one.loss_spans]
    assert spans == ["a\\\\b<<|document:3|>", "a\\\\b<<|document:4|>"] and one.attached_tokens == 512 + 75 + 1200
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and got[2].turns[0].text == ""
    assert chat_format.format_chats(df.limit(0)).count() == 0


# --- nearest neighbours -------------------------------------------------------


def exact(rows, asked, k):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in asked:
        score = x @ np.array(v, float)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [int(ids[j]) for j in order]
    return out


def test_ann_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    vectors = {i: np.array(v, float) for i, v in rows}
    got = defaultdict(list)
    for r in ann.op6_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
        assert abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id])) < 1e-12
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9


def test_ann_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.uniform(0.1, 9)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    odd = [(2000, None), (2001, [0.0] * 4), (2002, [float("nan")] * 4), (2003, [1.0, None, 1.0, 1.0]), (2020, [])]
    odd += [(2040, [float("inf"), 1.0, 1.0, 1.0]), (2060, [1.0]), (None, [9.0] * 4), (1000, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<float>, key int, score double")
    s = ann.Settings(k=5, recall=1.0, leaf_rows=7)
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0, s=s).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    given = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = exact(given, [r for r in given if r[0] % 20 == 0], 5)
    assert set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    assert all(got[i] == want[i] for i in want if i >= 1000)
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = df.where("vec_id IN (20, 21, 22)")
    assert ann.search(few, lambda i: i % 20 == 0).count() == 2


def test_ann_scores_a_leaf_of_many_queries_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(12_000, 4)), rng.normal(size=(4_000, 4))
    queries = pa.table({"key": pa.array(range(len(q))), "v": pa.array(q.tolist())})
    rows = pa.table({"key": pa.array(range(len(x))), "ids": pa.array([[i] for i in range(len(x))]), "v": pa.array(x.tolist())})
    tracemalloc.start()
    got = ann._score(3)(queries, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products at once would take 384 MB.
    assert peak < 100e6
    for i in (0, 255, 256, 11_999):
        assert np.frombuffer(got.column("ids")[i].as_py(), "<i8").tolist() == np.argsort(-(x @ q[i]))[:4].tolist()


def test_ann_deals_visits_and_rows_of_a_leaf_into_parts(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    # A third of the vectors lie in one region.
    m = np.vstack([rng.normal(size=(800, 4)), rng.normal(size=(400, 4)) * 0.01 + 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    score, noted = ann._score, str(tmp_path)

    def noting(*given):
        inner = score(*given)

        def run(queries, held):
            import uuid

            with open(f"{noted}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{queries.num_rows} {held.num_rows}")
            return inner(queries, held)

        return run

    monkeypatch.setattr(ann, "_score", noting)
    # Groups of about 24 vectors of 4 doubles.
    s = ann.Settings(k=5, recall=1.0, sample=200, trees=3, group_bytes=24 * 32)
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 2 == 0, s=s).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = exact(rows, [r for r in rows if r[0] % 2 == 0], 5)
    assert set(got) == set(want) and np.mean([got[i] == want[i] for i in want]) > 0.95
    sizes = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert max(a for a, _ in sizes) <= 60 and max(b for _, b in sizes) <= 60


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, odd, none):
    given = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(None).cast("double"))
    docs, sizes = given, [given.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == given.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(rows, given.schema)
        sizes.append(len(rows))
    # Substring dedup cuts texts and drops no document.
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.6 * sizes[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in docs.collect()}
    assert sum(labels.get(i) == 0 for i in left) <= 0.05 * sum(q == 0 for q in labels.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(last, {r.doc_id: r.text for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        assert stage(spark, odd, SF).count() > 0, name


def test_pipeline_query(spark):
    import __spark_entry__ as entry_points

    assert corpus_pipeline.run is entry_points.queries()["pipeline"]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
