import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallforge.functions import text as T
from recallforge.functions import vector as V
from recallforge.operators import context, graph, minisql, report, retrieve, state
from recallforge.operators.filters import Filter, valid_at
from recallforge.sources import ingest, wal


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_tokens_and_chunks(spark):
    assert one(spark, T.tokens(F.col("t")), t="Oracle-Listener, ÀÉ 12!") == ["oracle", "listener", "àé", "12"]
    assert one(spark, T.chunks(F.col("t"), 2), t="one two three four five") == ["one two", "three four", "five"]
    assert one(spark, T.chunks(F.col("t"), 2), t=" \n ") == []
    assert one(spark, T.normalised_query(F.col("t")), t="Postgres conexão x") == "postgresql connection x"
    assert T.query_tokens("Postgres, postgress x") == ["postgresql", "x"]


def test_scalars(spark):
    assert one(spark, T.checksum(F.col("t")), t="123456789") == "cbf43926"
    assert one(spark, T.approx_tokens(F.col("t")), t="é" * 3) == 2
    assert one(spark, T.mime(F.col("t")), t="Text/HTML; charset=x") == "text/html"
    assert one(spark, T.code_language(F.col("t")), t="text/x-Rust") == "rust"
    assert one(spark, T.render_prompt(F.lit("{{context}}|{{query}}"), F.col("t"), F.lit("q")), t="a {{query}}") == "a q|q"
    assert one(spark, T.parse_vector(F.col("t")), t="0.5, 2") == [0.5, 2.0]
    assert one(spark, T.parse_vector(F.col("t")), t="0.5,x") is None
    assert one(spark, T.parse_pairs(F.col("t")), t="a=b=c") == {"a": "b=c"}
    assert one(spark, T.parse_pairs(F.col("t")), t="=b") is None


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = ((h ^ x) * 0x100000001B3) % 2**64
    return h


def test_embedding(spark):
    words = ["", "a", "listener", "é", "postgresql", "a"]
    assert V.fnv([w.encode() for w in words]).tolist() == [fnv(w.encode()) for w in words]
    got = V.with_hash_embedding(spark.createDataFrame([("Oracle listener oracle",), ("",), (None,)], "text string")).collect()
    want = np.zeros(64)
    for w in ("oracle", "listener", "oracle"):
        want[fnv(w.encode()) % 64] += -1 if fnv(w.encode()) >> 32 & 1 else 1
    assert got[0].slots == want.tolist()
    assert np.allclose(got[0].embedding, want / np.linalg.norm(want)) and not any(got[1].embedding) and not any(got[2].embedding)
    assert np.allclose(V.embed("Oracle listener oracle"), want / np.linalg.norm(want))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 3.0], [1.0, 2.0]), ([0.0], [1.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 1 / math.sqrt(2)) < 1e-12 and got[1:] == [None] * 4


def test_hybrid_ranks_against_a_full_sort(spark):
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"], r.integers(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, [float(x) for x in r.integers(-2, 3, 4)]) for i, t in enumerate(texts)], "id long, text string, embedding array<double>")
    words, vector = ["alpha", "zeta"], [1.0, 0.5, 0.0, -1.0]
    got = retrieve.hybrid_search(df, words, vector, 15).collect()
    rows = retrieve.vector_scores(retrieve.text_scores(df, words), vector).select("id", "cos", "bm25").collect()
    near = {x.id for x in sorted((x for x in rows if x.cos is not None), key=lambda x: (-x.cos, x.id))[: retrieve.fetch_k(15)]}
    pool = [x for x in rows if x.id in near or x.bm25 > 0]
    n = len(pool)
    vr = {x.id: i + 1 for i, x in enumerate(sorted((x for x in pool if x.cos is not None), key=lambda x: (-x.cos, x.id)))}
    tr = {x.id: i + 1 for i, x in enumerate(sorted((x for x in pool if x.bm25 > 0), key=lambda x: (-x.bm25, x.id)))}
    want = sorted(((-(1 / (60 + vr.get(x.id, n + 1)) + 1 / (60 + tr.get(x.id, n + 1))), x.id) for x in pool))[:15]
    assert [(x.id, round(x.score, 12)) for x in got] == [(i, round(-s, 12)) for s, i in want]


def test_mmr(spark):
    df = spark.createDataFrame([("a", 0.9, [1.0, 0.0]), ("b", 0.8, [1.0, 0.0]), ("c", 0.5, [0.0, 1.0])], "id string, score double, embedding array<double>")
    order = lambda k, w: [r.id for r in retrieve.mmr(df, k, w).orderBy("place").collect()]
    assert order(2, 0.5) == ["a", "c"] and order(3, 1.0) == ["a", "b", "c"]


def test_min_max_single_row_is_one(spark):
    df = spark.createDataFrame([(1, 0.3)], "id long, cos double")
    assert retrieve.min_max(df, "cos").first().score == 1.0
    with pytest.raises(ValueError):
        retrieve.mode("fuzzy")


def test_filters(spark):
    df = spark.createDataFrame([(1, 10, 20), (2, None, 10), (3, 11, None), (4, None, None)], "id long, valid_from long, valid_until long")
    assert [r.id for r in df.where(valid_at(F.lit(10))).collect()] == [1, 4]
    with pytest.raises(ValueError):
        Filter(" ").column()


def test_pack_skips_and_goes_on(spark):
    text = lambda tokens, head: "x" * (4 * tokens - head)
    hits = spark.createDataFrame([(i + 1, "m", "a", text(n, 6)) for i, n in enumerate((5, 9, 3, 4))], "rank int, kind string, id string, text string")
    assert sorted(r["rank"] for r in context.pack(hits, 12).collect()) == [1, 3, 4]


def test_decay(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, None)], "s double, t long")
    got = [r.x for r in df.select(context.decay(F.col("s"), 0.5, 86_400_000 * 10, F.col("t"), 10.0).alias("x")).collect()]
    assert abs(got[0] - (0.5 + 0.5 / math.e)) < 1e-12 and got[1] == 0.75
    with pytest.raises(ValueError):
        context.decay(F.lit(1.0), 1.5, 0, F.lit(0), 1.0)


def test_contradictions_move_confident_memories_up(spark):
    hits = spark.createDataFrame([("a", 1, 0.5, "memory", 0.1, ["b"]), ("b", 2, 0.45, "memory", 0.9, [])], "id string, rank int, score double, kind string, confidence double, contradictions array<string>")
    assert [r.id for r in context.contradiction_rank(hits).orderBy("new_rank").collect()] == ["b", "a"]


def test_state(spark):
    log = spark.createDataFrame([(1, "put", "a", 1), (2, "put", "b", 2), (3, "delete", "a", None), (4, "put", "a", 5), (5, "delete", "b", None)], "seq long, op string, id string, v int")
    assert [(r.id, r.v) for r in state.live(log, "id").collect()] == [("a", 5)]
    assert [(r.id, r.version, r.created) for r in state.versions(log, "id").collect()] == [("a", 1, 4)]
    writes = spark.createDataFrame([("t", "a", 1, []), ("t", "b", 2, ["a"]), ("t", "c", 3, ["b"]), ("t", "b", 4, [])], "tenant_id string, id string, seq long, supersedes array<string>")
    assert [(r.id, r.superseded_by) for r in state.superseded(writes).collect()] == [("a", "b")]


def test_log_recovery(spark, tmp_path):
    make = lambda low, high: spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(low, high)], "seq long, body string").repartition(3)
    log, got = str(tmp_path / "log"), lambda path: [(r.pos, r.body) for r in wal.recover(spark, path).orderBy("pos").collect()]
    want = [(i, f'{{"n":{i}}}') for i in range(70)]
    for low, high in ((0, 3), (3, 60), (60, 61), (61, 70)):  # appends of unequal size
        wal.write(make(low, high), log, "seq")
        assert got(log) == want[:high]
    lines = [r.value for r in spark.read.text(log).collect()]
    hurt = {"torn": lambda x: x[:-2], "changed": lambda x: x.replace('"n"', '"m"'), "gone": lambda x: "", "moved": lambda x: x.replace("30\t", "31\t", 1)}
    for name, how in hurt.items():
        (tmp_path / name).mkdir()
        for k in range(4):  # the lines dealt out over files in no order, the thirtieth hurt
            some = [how(x) if x.startswith("30\t") else x for x in lines[k::4]]
            (tmp_path / name / f"part-{k}.txt").write_text("\n".join(some[::-1]) + "\n")
        assert got(str(tmp_path / name)) == want[:30]
        if name == "torn":
            with pytest.raises(wal.Damaged):
                wal.write(make(70, 71), str(tmp_path / name), "seq")
            assert wal.repair(spark, str(tmp_path / name), str(tmp_path / "mended")) == 30
            wal.write(make(30, 35), str(tmp_path / "mended"), "seq")
            assert got(str(tmp_path / "mended")) == want[:35]


def test_a_log_of_many_lines_is_numbered_without_gaps(spark, tmp_path):
    """So many bytes that Spark merges the ranges of the narrow rows that are counted, but not those of the lines that are written."""
    bodies = spark.range(0, 60_000, numPartitions=6).select(((F.col("id") * 7919) % 60_000).alias("seq")).withColumn("body", F.format_string('{"n":%d,"h":"%s"}', "seq", F.sha2(F.col("seq").cast("string").cast("binary"), 512)))
    wal.write(bodies, str(tmp_path / "log"), "seq")
    right = F.get_json_object("body", "$.n").cast("long") == F.col("pos")
    got = wal.recover(spark, str(tmp_path / "log")).agg(F.count("*"), F.max("pos"), F.count_if(right)).first()
    assert tuple(got) == (60_000, 59_999, 60_000)


def test_log_files_without_numbers(spark, tmp_path):
    import zlib

    tag = lambda x: f"{zlib.crc32(x.encode()):08x}\t{x}"
    (tmp_path / "a.log").write_text("\n".join([tag('{"n":0}'), "", '{"old":1}', tag('{"n":2}')[:-1], tag('{"n":3}')]))
    assert [r.body for r in wal.recover_file(spark, str(tmp_path / "a.log")).orderBy("pos").collect()] == ['{"n":0}', '{"old":1}']


def edges(spark):
    return spark.createDataFrame([(1, "e1", "a", "b", "x"), (2, "e2", "b", "c", "x"), (3, "e3", "d", "a", "y"), (4, "e4", "c", "e", "x")], "seq long, id string, from_id string, to_id string, relation string")


def test_traversal(spark):
    e = edges(spark)
    got = lambda *a, **k: [(r.node, r.hop, r.via_edge) for r in graph.traverse(e, *a, **k).orderBy("place").collect()]
    assert got(["a"]) == [("b", 1, "e1"), ("d", 1, "e3"), ("c", 2, "e2")]
    assert got(["a"], max_nodes=2) == [("b", 1, "e1"), ("d", 1, "e3")]
    assert got(["a"], relation="y") == [("d", 1, "e3")]
    assert got(["zz"]) == []
    assert {r.node for r in graph.traverse(e, ["a"], 3, None).collect()} == {"b", "d", "c", "e"}


@pytest.mark.parametrize("bad", ["select id from t", "select * from t where a != 1", "select * from t where a < 1", "select * from t order by a", "select * from t limit 0", "select * from t where a = 'x", "select * from t where a = é", "select * from t where a=1 and", "select * from 1t", "select * from t where a=1 or b=2"])
def test_statements_outside_the_language(bad):
    with pytest.raises(minisql.StatementError):
        minisql.parse(bad)


def test_statements():
    q = minisql.parse("SELECT * FROM systems WHERE engine = 'a and b' AND Env = prod AND metadata.tier=x and payload.a.b=\"1\" LIMIT 900;")
    assert (q.table, q.payload, q.metadata, q.limit) == ("systems", {"engine": "a and b", "Env": "prod", "a.b": "1"}, {"tier": "x"}, 500)
    assert minisql.parse("select * from records").table is None
    assert minisql.parse("select * from records where table=t and id= and a=1 and a=2").payload == {"a": "2"}
    assert minisql.parse("select * from t where ").payload == {}


def test_scalar_text(spark):
    payload = '{"a": null, "b": true, "c": 1.50, "d": "x", "e": [1], "f": {"g": 1}, "a.b": 7, "h": ""}'
    want = {"a": "null", "b": "true", "c": "1.5", "d": "x", "e": None, "f": None, "a.b": "7", "h": "", "zz": None}
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(*(minisql.scalar_text(F.col("p"), k).alias(k.replace(".", "_")) for k in want)).first() == tuple(want.values())


def test_retention(spark):
    log = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(300)], "seq long, body string")
    for n, size in ((7, None), (None, 40), (20, 30), (None, None), (500, 10_000), (None, 1)):
        want, used = [], 0
        for i in reversed(range(300)):
            used += i % 5 + 1
            if n and len(want) >= n or size and used > size:
                break
            want.append(i)
        assert sorted(r.seq for r in report.retained(log, n, size).collect()) == sorted(want)


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.json").write_text('{"z": 1, "a": [true, null, {"k": "v"}]}')
    (tmp_path / "c.csv").write_text("id, name\n1, x\n\n2\n")
    f = ingest.files(spark, str(tmp_path))
    assert {r.name: r.media_type for r in f.collect()} == {"a.txt": "text/plain", "b.json": "application/json", "c.csv": "text/csv"}
    docs = {r.id: r.text for r in ingest.documents(f, "t", "c", 1).collect()}
    assert docs["file:a.txt"] == "hello" and docs["file:b.json"] == "table b record b.json a true null k v z 1"
    assert [(r.table, r.payload) for r in ingest.csv_records(f.where("extension = 'csv'")).orderBy("row").collect()] == [("c", {"id": "1", "name": "x"}), ("c", {"id": "2", "name": ""})]
    got = ingest.json_records(spark.createDataFrame([("/x/t.json", '[{"a":1},{"a":[2]}]')], "path string, text string")).orderBy("row").collect()
    assert [(r.table, r.payload) for r in got] == [("t", '{"a":1}'), ("t", '{"a":[2]}')]
    (tmp_path / "d.exe").write_text("x")
    with pytest.raises(Exception, match="cannot be imported"):
        ingest.files(spark, str(tmp_path)).collect()


def test_code_chunks():
    code = "use x;\nfn a() {\n  1\n}\nfn b() { 2 }\nstruct C;"
    assert ingest.code_chunks(code, "rust", 8) == ["use x;\nfn a() {\n  1\n}", "fn b() { 2 }\nstruct C;"]
    assert ingest.code_chunks(code, "rust", 4) == ["use x;\n", "fn a() { 1", "}\n", "fn b() { 2", "}\nstruct C;"]  # what follows a cut segment joins its last words
    assert ingest.code_chunks("def a():\n  pass\ndef b():\n  pass", "python", 30) == ["def a():\n  pass\ndef b():\n  pass"]
    assert ingest.code_chunks("def a():\n  pass\ndef b():\n  pass", "py", 3) == ["def a(): pass", "def b(): pass"]  # no such language: words
    assert ingest.code_chunks("macro_rules! m\npub static X: u8\ntype T = u8", "rust", 3) == ["macro_rules! m\n", "pub static X:", "u8 type T", "= u8"]
    assert ingest.code_chunks("a b c", "cobol", 2) == ["a b", "c"] and ingest.code_chunks(" ", "rust", 2) == []
    assert ingest.code_chunks("var a = 1\r\nlet b\r\n", "ts", 4) == ["var a = 1", "let b"]


def test_postings_and_many_queries(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, ""), (4, None), (5, "c c c b")], "id long, text string")
    got = {(r.key, r.token): (r.f, r.dl) for r in retrieve.postings(df).collect()}
    assert got == {(1, "a"): (1, 3), (1, "b"): (2, 3), (2, "a"): (1, 1), (5, "c"): (3, 4), (5, "b"): (1, 4)}
    asked = spark.createDataFrame([("x", "A b"), ("y", "c"), ("z", "nothing")], "query_id string, query string")
    many = {(r.query_id, r["rank"]): (r.key, round(r.bm25, 9)) for r in retrieve.text_search_many(df, asked, 2).collect()}
    for q, words in (("x", ["a", "b"]), ("y", ["c"]), ("z", ["nothing"])):
        one = retrieve.top(retrieve.text_scores(df, words).where("bm25 > 0"), 2, "bm25").collect()
        assert [many.get((q, i + 1)) for i in range(len(one))] == [(r.id, round(r.bm25, 9)) for r in one]
        assert (q, len(one) + 1) not in many


def test_retrieval_quality(spark):
    ranked = spark.createDataFrame([("a", 1, "x", "Start the Listener"), ("a", 2, "y", "other"), ("b", 1, "z", "no"), ("b", 2, "x", "vacuum")], "case string, rank int, id string, text string")
    relevant = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "q")], "case string, id string")
    r = report.quality(ranked, relevant, 5).first()
    assert (r.cases, round(r.hit_at_1, 6), round(r.hit_at_k, 6), r.mrr) == (3, 0.333333, 0.666667, 0.5)
    cases = spark.createDataFrame([("a", ["x"], ["z"], ["listener"]), ("b", ["x"], ["z"], ["VACUUM"]), ("c", [], [], ["q"])], "case string, expected_first array<string>, forbidden_first array<string>, must_include array<string>")
    got = {c.case: (c.first_ok, c.not_forbidden, c.answer_ok) for c in report.case_checks(ranked, cases).collect()}
    assert got == {"a": (True, True, True), "b": (False, False, True), "c": (True, True, False)}
