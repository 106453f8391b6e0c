import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionlake.operators import chat, neighbours, postings, retrieve
from opinionlake.plans import pipeline
from opinionlake.plans.catalog import QUERIES
from opinionlake.profiles import NO_HITS_MESSAGE, SUBJECT_MISSING_MESSAGE
from opinionlake.sources import files, index
from opinionlake.sources.samples import SCHEMAS


def vectors(spark, name, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, vec array<float>")


def small_blocks(monkeypatch, size):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", size)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 9)
    monkeypatch.setattr(neighbours, "ASKED", 7)


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("block_bytes", [8 << 20, 8 * 8 * 16])
def test_nearest_equals_brute_force(spark, monkeypatch, block_bytes, metric):
    """Also with many small blocks on both sides and a third of equal vectors."""
    small_blocks(monkeypatch, block_bytes)
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(90, 8)).astype(np.float32)
    corpus[::3] = corpus[0]
    asked = np.vstack([corpus[0], rng.normal(size=(40, 8)).astype(np.float32)])
    got = retrieve.nearest(vectors(spark, "query_id", asked), vectors(spark, "doc_id", corpus), dim=8, k=4, metric=metric).collect()
    cost = ((asked[:, None].astype(float) - corpus[None].astype(float)) ** 2).sum(axis=2).round(6)
    if metric == "dot":
        cost = -(asked.astype(float) @ corpus.astype(float).T).round(6)
    best = {q: [d for d in sorted(range(90), key=lambda d: (cost[q, d], d))[:4] if metric == "l2" or cost[q, d] < 0] for q in range(len(asked))}
    assert [(r.query_id, r.doc_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(q, d) for q in best for d in best[q]]
    assert all(abs(abs(r.score) - abs(cost[r.query_id, r.doc_id])) < 1e-6 for r in got)


def test_questions_of_a_task_leave_it_in_one_pack(spark, monkeypatch):
    """However many packs they came in, so the packs for the far cells don't get smaller and more with the questions."""
    small_blocks(monkeypatch, 8 << 20)
    monkeypatch.setattr(neighbours, "PAIRS", 5)
    m = np.random.default_rng(11).normal(size=(600, 8)).astype(np.float32)
    asked, corpus = vectors(spark, "query_id", m).repartition(8), vectors(spark, "doc_id", m)
    packs = neighbours.partitions(asked, corpus, 8, 3, "l2")[1]
    groups = packs.select("group").distinct().count()
    assert groups > 10 and packs.count() <= 8 * groups + groups * (groups - 1)
    got = retrieve.nearest(asked, corpus, 8, 3).collect()
    cost = ((m[:, None].astype(float) - m[None].astype(float)) ** 2).sum(axis=2).round(6)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [
        (q, n + 1, int(d)) for q in range(600) for n, d in enumerate(np.lexsort((np.arange(600), cost[q]))[:3])
    ]


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("scale", [1e-9, 1e-3, 1, 1e5, 1e11])
def test_single_precision_leaves_no_pair_out(metric, scale):
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(500, 16)) + rng.normal(size=16) * 30) * scale
    asked = np.vstack([rows[:20], rows[20:40] * (1 + 1e-7), rng.normal(size=(20, 16)) * scale])
    square = (rows**2).sum(axis=1).max() if metric == "dot" else None
    cells = neighbours.Cells(np.zeros((1, 17 if metric == "dot" else 16)), square)
    cost = cells.cost(asked, rows)
    least = np.sort(cost, axis=1)[:, 3]
    q, r = cells.within(asked, cells.single(rows), np.sqrt((rows**2).sum(axis=1).max()), least)
    found = np.zeros(cost.shape, bool)
    found[q, r] = True
    assert found[cost <= least[:, None]].all() and (scale < 1e-5 or found.mean() < 0.9)
    assert cells.single(rows * (1e16 / scale)) is None


def test_nearest_of_vectors_too_large_for_single_precision(spark, monkeypatch):
    small_blocks(monkeypatch, 8 << 20)
    m = np.random.default_rng(12).normal(size=(200, 8)) * 1e17
    one = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, vec array<double>")
    got = retrieve.nearest(one.withColumnRenamed("doc_id", "query_id"), one, 8, 2).collect()
    cost = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    np.fill_diagonal(cost, np.inf)
    assert {r.query_id: r.doc_id for r in got if r["rank"] == 2} == dict(enumerate(cost.argmin(axis=1).tolist()))


def test_nearest_leaves_out_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (7, [])]
    corpus = spark.createDataFrame(rows, "doc_id long, vec array<float>")
    asked = spark.createDataFrame([(str(i), v) for i, v in rows], "query_id string, vec array<float>")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in retrieve.nearest(asked, corpus, 2).collect())
    assert got == [("1", 1, 1), ("1", 2, 6), ("6", 1, 6), ("6", 2, 1)]


def test_nearest_smaller_corpus_than_k_and_empty(spark):
    one = vectors(spark, "query_id", [[1, 0]])
    assert [r.rank for r in retrieve.nearest(one, vectors(spark, "doc_id", [[1, 0], [0, 1]]), 2, 4).collect()] == [1, 2]
    empty = vectors(spark, "doc_id", [[1, 0]]).where("doc_id < 0")
    assert retrieve.nearest(one, empty, 2, 4).count() == 0


def test_lexical_finds_rare_words(spark):
    corpus = spark.createDataFrame(
        [(1, "good book story"), (2, "fast delivery box"), (3, "good delivery book"), (4, "story story book"), (5, None), (6, "ÉCOLE 책방 x1")],
        "doc_id long, text string",
    )
    asked = spark.createDataFrame(
        [("10", "delivery book"), ("11", "unknown words"), ("12", ""), ("13", "école"), ("14", "책방!"), ("15", None)], "query_id string, text string"
    )
    got = retrieve.nearest_terms(asked, corpus, "query_id", "doc_id").orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {"10", "13", "14"}
    assert [r.doc_id for r in got if r.query_id == "10"][0] == 3
    assert [(r.doc_id, r["rank"]) for r in got if r.query_id in ("13", "14")] == [(6, 1), (6, 1)]


def test_far_cells_are_not_visited(spark, monkeypatch):
    """Of twenty groups that lie apart a question sees a few, and still finds what all products give."""
    small_blocks(monkeypatch, 8 << 20)
    rng = np.random.default_rng(2)
    m = np.repeat(rng.normal(size=(20, 8)) * 10, 40, axis=0) + rng.normal(size=(800, 8)) / 10
    asked, corpus = vectors(spark, "query_id", m[::10]), vectors(spark, "doc_id", m)
    cells = neighbours.partitions(asked, corpus, 8, 3, "l2")[1].select("group").distinct().count()
    parts = [r.parts for r in retrieve.touched(asked, corpus, 8, 3).collect()]
    assert len(parts) == 80 and cells > 10 and np.mean(parts) < cells / 4
    got = retrieve.nearest(asked, corpus, 8, 1).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(i, 10 * i) for i in range(80)]


def test_questions_do_not_pass_the_driver(spark, monkeypatch):
    frame = type(spark.range(0))
    taken, plain, listed = [], frame.toArrow, frame.collect
    monkeypatch.setattr(frame, "toArrow", lambda self: taken.append(plain(self)) or taken[-1])
    monkeypatch.setattr(frame, "collect", lambda self: taken.append(listed(self)) or taken[-1])
    monkeypatch.setattr(neighbours, "SAMPLE", 20)
    m = np.random.default_rng(5).normal(size=(400, 8))
    df = retrieve.nearest(vectors(spark, "query_id", m), vectors(spark, "doc_id", m), 8, k=2)
    texts = [(i, f"word{i} common") for i in range(400)]
    found = retrieve.nearest_terms(spark.createDataFrame(texts, "q long, text string"), spark.createDataFrame(texts, "d long, text string"), "q", "d")
    assert max(len(t) for t in taken) <= 40
    monkeypatch.undo()
    assert [r.doc_id for r in df.where("rank = 1").orderBy("query_id").collect()] == list(range(400))
    assert [r.doc_id for r in found.where("rank = 1").orderBy("query_id").collect()] == list(range(400))


@pytest.mark.parametrize("small", [False, True])
def test_terms_equal_brute_force(spark, monkeypatch, small):
    """Small shards, groups and blocks; words of all frequencies, ties and repeated texts."""
    if small:
        monkeypatch.setattr(postings, "SHARD_WORDS", 150)
        monkeypatch.setattr(postings, "GROUP_BYTES", 2000)
        monkeypatch.setattr(postings, "BLOCK", 7)
        monkeypatch.setattr(postings, "CELLS", 64)
        monkeypatch.setattr(postings, "ENTRIES", 30)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.3, size=rng.integers(0, 30)) % 500) for _ in range(150)]
    texts[10:20] = [texts[3]] * 10
    asked = [*texts[::5], "nothing known", ""]
    docs = [t.split() for t in texts]
    df = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}
    idf = {w: np.log((1 + len([d for d in docs if d])) / (1 + n)) + 1 for w, n in df.items()}

    def unit(words):
        v = {w: words.count(w) * idf[w] for w in set(words) if w in idf}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    held, expected = [unit(d) for d in docs], []
    for q, text in enumerate(asked):
        mine = unit(text.split())
        scores = sorted((-round(sum(x * v.get(w, 0) for w, x in mine.items()), 6), d) for d, v in enumerate(held))
        expected += [(q, n + 1, d) for n, (s, d) in enumerate(scores[:4]) if s < 0]
    left = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    right = spark.createDataFrame([*enumerate([t or None for t in texts])], "doc_id long, text string").where("text IS NOT NULL")
    got = retrieve.nearest_terms(left, right, "query_id", "doc_id").collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == expected


def test_common_words_are_not_read_to_their_end():
    """A rare word decides; the list of the word that all documents hold is only looked up."""
    n = 5000
    docs = np.append(np.arange(n), np.arange(5)).astype("<u4")
    weights = np.append(np.full(n, 0.01), np.linspace(0.9, 0.8, 5))
    lists = postings.Lists({"ids": np.arange(n).tobytes(), "counts": np.array([n, 5], "<u4").tobytes(), "docs": docs.tobytes(), "weights": weights.tobytes()})
    of, doc, score, read = lists.best(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([0.1, 0.9, 1.0]), 2, 4)
    assert doc.tolist() == [0, 1, 2, 3] * 2 and score[0] == round(0.81 + 0.001, 6) and read == 5 + n


def test_a_shard_of_one_document_comes_to_an_end():
    """All words of the question stay open, as one document can't fill the k best."""
    row = {"ids": np.array([7]).tobytes(), "counts": np.array([1, 1], "<u4").tobytes(), "docs": np.zeros(2, "<u4").tobytes()}
    lists = postings.Lists(row | {"weights": np.array([0.6, 0.8]).tobytes()})
    of, doc, score, _ = lists.best(np.array([0, 0]), np.array([0, 1]), np.array([0.8, 0.6]), 1, 4)
    assert (of.tolist(), doc.tolist(), score.tolist()) == ([0], [0], [0.96])


def test_a_floor_leaves_out_only_what_scores_less():
    docs = np.arange(6, dtype="<u4")
    row = {"ids": np.arange(6).tobytes(), "counts": np.array([6], "<u4").tobytes(), "docs": docs.tobytes()}
    lists = postings.Lists(row | {"weights": np.linspace(0.1, 0.6, 6).tobytes()})
    of, doc, score, read = lists.best(np.array([0, 1]), np.array([0, 0]), np.ones(2), 2, 4, np.array([0.5, 0.7]))
    assert (of.tolist(), doc.tolist(), read) == ([0, 0], [5, 4], 6)


def test_the_index_is_not_shuffled_to_the_questions(spark, monkeypatch):
    """Blocks meet the written index where it is; what a task hands on is k rows of each of its questions and parts."""
    monkeypatch.setattr(postings, "SHARD_WORDS", 50)
    monkeypatch.setattr(postings, "BLOCK", 10)
    frame = type(spark.range(0))
    plans, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: plans.append(self) or plain(self, *a, **b))
    texts = spark.createDataFrame([(i, f"word{i % 40} common more") for i in range(300)], "id long, text string")
    found = retrieve.nearest_terms(texts.where("id < 60"), texts, "id", "id")
    whole = plans[-1]._jdf.queryExecution().executedPlan().toString()
    index_side = whole[: whole.index("MapInArrow")]
    assert "weights" in index_side and "Exchange" not in index_side and "Generate" not in whole[: whole.index("Exchange")]
    assert found.count() == 240


def test_a_blocks_questions_come_to_a_task_once(spark, monkeypatch):
    """Every block meets every shard, but brings its questions with the first shard of a part only."""
    monkeypatch.setattr(postings, "SHARD_WORDS", 50)
    monkeypatch.setattr(postings, "BLOCK", 30)
    frame = type(spark.range(0))
    plans, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: plans.append(self) or plain(self, *a, **b))
    texts = spark.createDataFrame([(i, f"word{i % 40} common more") for i in range(300)], "id long, text string")
    found = retrieve.nearest_terms(texts.where("id < 60"), texts, "id", "id")
    pairs = plans[-1].select("shard", F.size("query_ids").alias("n"), F.spark_partition_id().alias("task")).collect()
    shards, tasks = len({r.shard for r in pairs}), len({r.task for r in pairs})
    brought = sum(r.n for r in pairs if r.n and r.n > 0)
    assert shards > 20 and tasks < shards and brought * 2 < 60 * shards and brought % 60 == 0
    assert found.count() == 240


def test_alike_documents_share_shards(spark, monkeypatch, tmp_path):
    """Two kinds of texts that come in turn: hardly a shard holds both, so most questions pass by half of the shards."""
    monkeypatch.setattr(postings, "SHARD_WORDS", 3000)
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.5, size=30) % 50)) for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(postings, "spread", lambda df, key: df)
    shards = postings.build(docs, "doc_id", "text", str(tmp_path / "ix"))[0].collect()
    sides = [{int(i) % 2 for i in np.frombuffer(r.ids, "<i8")} for r in shards]
    assert sum(len(r.ids) // 8 for r in shards) == 1000 and len(sides) > 8
    assert sum(len(s) == 1 for s in sides) > 0.8 * len(sides)


@pytest.mark.parametrize("name", ["lexical_topk", "rag_context"])
def test_queries_bring_each_question_once_a_part(spark, monkeypatch, tmp_path, name):
    texts = [(i, f"word{i} some{i % 7} common", "en", "web", 9) for i in range(200)]
    tables = {
        "documents": spark.createDataFrame(texts, SCHEMAS["documents"]),
        "conversations": spark.createDataFrame([(i, 0, "user", f"word{i} some{i % 5}") for i in range(50)], SCHEMAS["conversations"]),
        "events": spark.range(200).selectExpr("id AS event_id", "timestamp_ntz'2020-01-01' AS ts", "id AS user_id", "'a' AS event_type", "3.0D AS value", "'' AS props"),
        "orders": spark.range(200).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "timestamp_ntz'1995-03-04' AS o_orderdate", "'1' AS o_orderpriority"),
    }
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(postings, "SHARD_WORDS", 12)
    frame = type(spark.range(0))
    plans, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: plans.append(self) or plain(self, *a, **b))
    result = QUERIES[name](spark, str(tmp_path)).collect()
    pairs = plans[-1].select(F.size("query_ids").alias("n"), F.spark_partition_id().alias("task")).collect()
    tasks = len({r.task for r in pairs})
    assert len(pairs) > 2 * tasks and sum(r.n > 0 for r in pairs if r.n is not None) == tasks
    assert len({r.query_id for r in result}) == 50


def test_single_precision_leaves_nothing_out():
    """Scores that differ by less than single precision tells apart: the best of them, and ties by id, come out exactly."""
    rng = np.random.default_rng(8)
    n, words = 3000, 40
    table = rng.random((words, n)) * (rng.random((words, n)) < np.linspace(0.01, 0.9, words)[:, None])
    table[:, 1000:2000] = table[:, :1000] * (1 + 1e-7 * rng.random((words, 1000)))
    table /= np.maximum(np.sqrt((table * table).sum(axis=0)), 1e-9)
    place, docs = np.nonzero(table)
    counts = np.bincount(place, minlength=words).astype("<u4")
    ids = rng.permutation(n)
    lists = postings.Lists({"ids": ids.tobytes(), "counts": counts.tobytes(), "docs": docs.astype("<u4").tobytes(), "weights": table[place, docs].tobytes()})
    asked = rng.random((60, words)) * (rng.random((60, words)) < 0.3)
    asked /= np.sqrt((asked * asked).sum(axis=1, keepdims=True))
    q, p = np.nonzero(asked)
    scores = (asked @ table).round(postings.DIGITS)
    order = np.stack([np.lexsort((ids, -s))[:4] for s in scores])
    for floor in (0.0, scores[np.arange(60), order[:, 3]]):
        of, doc, score, _ = lists.best(q, p, asked[q, p], 60, 4, floor)
        assert of.tolist() == np.repeat(np.arange(60), 4).tolist() and doc.tolist() == order.ravel().tolist()
        assert np.abs(score - scores[of, doc]).max() < 1.5 * 10.0**-postings.DIGITS


def test_embed_hook_and_index_reuse(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa"), (2, "bbb")], "doc_id long, page_content string")
    built = []

    def corpus():
        built.append(1)
        return retrieve.embed(docs, "page_content", lambda texts: [[float(len(t)), 1.0] for t in texts])

    for _ in range(2):
        table, meta = index.build_or_load_index(spark, str(tmp_path / "ix"), corpus, "docs")
        assert tuple(meta.first()) == (2, "docs")
        assert {r.doc_id: list(r.embedding) for r in table.collect()} == {1: [2.0, 1.0], 2: [3.0, 1.0]}
    assert len(built) == 1


def test_corpus_cap_counts_before_blank_drop(spark):
    rows = spark.createDataFrame(
        [(1, "kyobo", None, "raw", 5.0, None), (2, "kyobo", "\n\t\u00a0", "x", 5.0, None), (3, "kyobo", None, None, 5.0, None),
         (4, "kyobo", "c", "x", 5.0, None), (5, "kyobo", "d", "x", 5.0, None)],
        "review_seq long, site string, content_clean string, content string, rating double, date timestamp",
    )
    got = sorted((r.doc_id, r.page_content) for r in index.load_corpus(rows, cap=3).collect())
    assert got == [(1, "raw"), (4, "c")]


def test_context_lines_and_message(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame(
        [(1, 2, "b.csv", None, None, "둘"), (1, 1, None, 4.5, "2024-01-01", "하나")],
        "query_id long, rank int, source string, rating double, date string, content string",
    )
    got = {r.query_id: (r.n_hits, r.context) for r in chat.context(asked, hits).collect()}
    assert got[1] == (2, "[1] (unknown, rating=4.5, date=2024-01-01) 하나\n[2] (b.csv, rating=NA, date=NA) 둘")
    assert got[2] == (0, NO_HITS_MESSAGE)


def test_subjects_from_json(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"b1": {"title": "T", "author": "A", "summary": "S", "keywords": ["k1", "k2"]},\n "b2": {"keywords": []}}')
    subjects = files.read_subjects(spark, str(path))
    wanted = spark.createDataFrame([(1, "b1"), (2, "b2"), (3, "none")], "id long, key string")
    got = {r.id: r.response for r in chat.lookup_subject(wanted, subjects).collect()}
    assert got[1] == "제목: T\n저자: A\n요약: S\n키워드: k1, k2"
    assert got[2] == "제목: b2\n저자: 정보 없음\n요약: 정보 없음"
    assert got[3] == SUBJECT_MISSING_MESSAGE


def test_routes_and_sites(spark):
    df = spark.createDataFrame([("\u00a0RAG_Review\n",), ("subject_info",), ("other",), (None,)], "l string")
    assert [r.r for r in df.select(chat.route(F.col("l")).alias("r")).collect()] == [
        "rag_review", "subject_info", "chat", "chat"
    ]
    sites = spark.createDataFrame([("\tKyobo \r\n",), ("x",)], "s string").select(chat.normalize_site(F.col("s")).alias("s"))
    assert [r.s for r in sites.collect()] == ["kyobo", None]


def test_history_across_slices(spark, monkeypatch):
    monkeypatch.setattr(chat, "HISTORY_SLICE", 3)
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * t) for c in (1, 2) for t in range(10)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in (1, 2):
        rows = chat.history(df).where(F.col("conv_id") == c).orderBy("turn").collect()
        so_far = []
        for r in rows:
            so_far.append(r.line)
            assert (r.position, r.history_chars) == (len(so_far), len("\n".join(so_far)))


def test_plans_carry_no_whole_conversation_list(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert "collect_list" not in chat.history(df)._jdf.queryExecution().executedPlan().toString()


def test_features_attach_keeps_rows(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(1, 0.5)], "id long, f double")
    assert sorted((r.id, r.f) for r in pipeline.attach(a, b, "id").collect()) == [(1, 0.5), (2, None)]
