import pytest

from recallforge.sources.store import Config, MemoryStore, NotFound, Recall, StoreError


class Clock:
    t = 1_000

    def __call__(self):
        self.t += 1
        return self.t


@pytest.fixture
def db(spark, tmp_path):
    db = MemoryStore(spark, str(tmp_path / "db"), now=Clock())
    db.create_tenant("acme"), db.create_collection("acme", "support")
    return db


def ids(df):
    return [r.id for r in df.collect()]


def test_documents_versions_and_reopening(spark, db, tmp_path):
    first = db.store_document("acme", "support", "d1", "one two three", metadata={"k": "v"})
    db.store_document("acme", "support", "d1", " ".join(map(str, range(100))))
    again = db.get("document", "acme", "support", "d1")
    assert (again.version, again.created_at) == (2, first.created_at) and again.updated_at > first.updated_at
    assert [r.ordinal for r in db.chunks_of("acme", "support", "d1").collect()] == [0, 1, 2]
    db.store_document("acme", "support", "d1", "short")
    db.compact()
    other = MemoryStore(spark, str(tmp_path / "db"))
    assert [r.text for r in other.chunks_of("acme", "support", "d1").collect()] == ["short"]
    assert other.get("document", "acme", "support", "d1").version == 3
    with pytest.raises(StoreError):
        db.store_document("acme", "support", "d2", "  ")
    with pytest.raises(NotFound):
        db.store_document("acme", "nowhere", "d2", "x")
    assert db.create_tenant("acme", "New name").name == "acme"


def test_supersession_outlives_the_superseder(db):
    db.remember_many("acme", "support", [{"key": "a", "text": "listener port is 1521", "confidence": 0.2}, {"key": "x", "text": "listener other"}])
    db.remember("acme", "support", "b", "listener port is 1522", supersedes=["a"])
    assert set(ids(db.recall(Recall("acme", "listener port")))) == {"b", "x"}
    db.forget("acme", "support", "b")
    assert ids(db.recall(Recall("acme", "listener port"))) == ["x"]
    assert "a" in ids(db.recall(Recall("acme", "listener port", include_superseded=True)))
    db.rate_memory("acme", "support", "a", 0.9)
    assert db.get("memory", "acme", "support", "a").superseded_by == "b"
    db.remember("acme", "support", "a", "listener port is 1521")
    assert db.get("memory", "acme", "support", "a").superseded_by is None
    with pytest.raises(NotFound):
        db.remember("acme", "support", "c", "x", supersedes=["zz"])
    with pytest.raises(StoreError):
        db.rate_memory("acme", "support", "a", 1.5)


def test_retrieval_modes_filters_and_tenants(db):
    db.create_tenant("beta"), db.create_collection("beta", "support")
    db.remember_many("acme", "support", [
        {"key": "m1", "text": "oracle listener refused", "metadata": {"env": "prod"}, "user_id": "u1", "memory_type": "semantic"},
        {"key": "m2", "text": "postgresql vacuum", "metadata": {"env": "test"}, "valid_until": 50},
        {"key": "m3", "text": "oracle staging", "metadata": {"env": "prod"}},
    ])
    db.remember("beta", "support", "m1", "oracle secret of beta")
    assert ids(db.search(Recall("acme", "oracle", mode="text", as_of=100))) == ["m3", "m1"]
    assert ids(db.search(Recall("acme", "postgres", mode="text", as_of=10))) == ["m2"]
    assert ids(db.search(Recall("acme", "postgres", mode="text", as_of=60))) == []
    assert ids(db.search(Recall("acme", "oracle", mode="vec", metadata={"env": "prod"}, user="u1"))) == ["m1"]
    assert ids(db.search(Recall("acme", "oracle", memory_type="semantic"))) == ["m1"]
    assert ids(db.search(Recall("nobody", "oracle"))) == []
    assert ids(db.search(Recall("acme", "", mode="vector"))) == []
    assert ids(db.search(Recall("acme", mode="vector", embedding=[1.0, 0.0]))) == []
    assert len(ids(db.search(Recall("acme", "oracle", mmr=True, top_k=2)))) == 2
    top = db.search(Recall("acme", "oracle listener", top_k=1)).first()
    assert top.id == "m1" and top.matched_terms == ["listener", "oracle"] and top.reason.startswith("hybrid/rrf(")
    with pytest.raises(StoreError):
        db.search(Recall("acme", " "))


def test_records_sql_graph_context_and_audit(db):
    db.put_record("acme", "support", "systems", "pg", {"engine": "postgresql", "env": "prod", "n": None}, {"tier": "db"})
    db.put_record("acme", "support", "systems", "ora", {"engine": "oracle", "env": "prod"})
    assert db.put_record("acme", "support", "systems", "ora", {"engine": "oracle", "env": "test"}).version == 2
    assert ids(db.execute_sql("acme", "SELECT * FROM systems WHERE engine = 'postgresql' AND n = null")) == ["pg"]
    assert ids(db.execute_sql("acme", "SELECT * FROM records LIMIT 5")) == ["pg", "ora"]
    db.remember("acme", "support", "m", "postgresql runs on the first system")
    db.add_edge("acme", "e1", "record", "pg", "memory", "m", "about")
    db.add_edge("acme", "e2", "record", "pg", "record", "ora", "next to")
    with pytest.raises(NotFound):
        db.add_edge("acme", "e3", "record", "zz", "memory", "m", "about")
    assert [(r.node, r.hop) for r in db.traverse("acme", ["m"]).collect()] == [("pg", 1), ("ora", 2)]
    got = db.build_context("acme", "postgresql", 1000, top_k=2)
    assert got["related_item_ids"] and "[memory:m]" in got["text"]
    assert db.build_context("acme", "postgresql", 3)["items"] == []
    assert db.query_audit("acme").count() == 2
    db.compact_audit(records=1)
    assert db.query_audit("acme").count() == 1
    db.delete("record", "acme", "support", "pg", "systems")
    assert db.list("edge", "acme").count() == 0
    assert db.delete_table("acme", "support", "systems") == 1
    assert {r.entity: r.rows for r in db.stats().collect()}["memory"] == 1
    db.put_prompt("acme", "p", "name", "Say {{query}}")
    assert ids(db.prompts("acme")) == ["p"]


def test_files(db, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notes.md").write_text("oracle notes")
    assert db.import_files("acme", "support", str(tmp_path / "in")) == 1
    assert db.get("document", "acme", "support", "file:notes.md").metadata["media_type"] == "text/markdown"
    assert db.get("file", "acme", "support", "notes.md").document_id == "file:notes.md"
    db.delete("file", "acme", "support", "notes.md")
    assert db.list("document", "acme").count() == 0 and db.list("chunk", "acme").count() == 0
    for folder, text in (("a", "one " * 60), ("b", "two")):  # equal names in two folders
        (tmp_path / "deep" / folder).mkdir(parents=True)
        (tmp_path / "deep" / folder / "same.txt").write_text(text)
    assert db.import_files("acme", "support", str(tmp_path / "deep")) == 0  # a folder's own files only
    for folder in ("a", "b"):
        assert db.import_files("acme", "support", str(tmp_path / "deep" / folder)) == 1
    assert db.get("document", "acme", "support", "file:same.txt").version == 2 and [r.text for r in db.chunks_of("acme", "support", "file:same.txt").collect()] == ["two"]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"%PDF one page")
    with pytest.raises(Exception, match="no PDF reader"):
        db.import_files("acme", "support", str(tmp_path / "pdf"))
    assert db.import_files("acme", "support", str(tmp_path / "pdf"), pdf=lambda raw: raw[5:].decode()) == 1
    assert db.get("document", "acme", "support", "file:x.pdf").text == "one page"


def test_uploaded_records(db, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "hosts.csv").write_text("name, role\npg1, db\nweb1\n")
    (tmp_path / "up" / "sites.json").write_text('[{"city": "Rome"}, {"city": "Oslo", "n": 2}]')
    assert db.upload_records("acme", "support", str(tmp_path / "up")) == 4
    assert db.get("record", "acme", "support", "hosts-0", "hosts").payload == '{"name":"pg1","role":"db"}'
    assert ids(db.execute_sql("acme", "SELECT * FROM sites WHERE city = 'Oslo'")) == ["sites-1"]
    assert "pg1" in db.get("record", "acme", "support", "hosts-0", "hosts").projection
    assert db.upload_records("acme", "support", str(tmp_path / "up")) == 4 and db.get("record", "acme", "support", "sites-1", "sites").version == 2
    (tmp_path / "up" / "bad.json").write_text('[{"a": 1}, 5]')
    with pytest.raises(StoreError):
        db.upload_records("acme", "support", str(tmp_path / "up"))


def test_new_ids_and_compaction_by_bytes(spark, tmp_path):
    db = MemoryStore(spark, str(tmp_path / "c"), Config(auto_compact_ops=0, auto_compact_bytes=4000), now=Clock())
    db.create_tenant("t"), db.create_collection("t", "c")
    one, two = (db.remember("t", "c", None, x).id for x in ("first text", "second text"))
    assert one != two and one.startswith("mem-") and db.store_document("t", "c", None, "a text").id.startswith("doc-") and db.generation == 0
    db.remember("t", "c", one, "long " * 900)
    assert db.generation == 1 and db.list("memory", "t").count() == 2 and MemoryStore(spark, str(tmp_path / "c")).generation == 1


def test_the_store_ranks_as_the_operators(db):
    """One pool depth: what the store returns, in vector and hybrid mode, has the scores of the operators over the same entries."""
    import random

    from recallforge.operators import retrieve

    r = random.Random(4)
    db.remember_many("acme", "support", [{"key": f"m{i:04}", "text": " ".join(r.choice(["oracle", "listener", "port", "disk", "x"]) for _ in range(6)), "embedding": [r.gauss(0, 1) for _ in range(64)]} for i in range(700)])
    entries, vector = db.entries(), [r.gauss(0, 1) for _ in range(64)]
    got = [(x.id, round(x.score, 9)) for x in db.search(Recall("acme", "", mode="vector", embedding=vector)).collect()]
    assert got == [(x.id, round(x.score, 9)) for x in retrieve.vector_search(entries, vector, 10, "key").orderBy("score", ascending=False).collect()]
    got = [(x.id, round(x.score, 12), x.reason) for x in db.search(Recall("acme", "oracle port", embedding=vector)).collect()]
    want = {x.key: x for x in retrieve.hybrid_search(entries, ["oracle", "port"], vector, 10, "key").collect()}
    assert got == [(x.key.split("\u0001")[-1], round(x.score, 12), x.reason) for x in sorted(want.values(), key=lambda x: (-x.score, x.key))]
    low = sorted(x[1] for x in got)[3]
    every = ids(db.search(Recall("acme", "oracle port", embedding=vector, min_score=low, top_k=10)))
    assert every == [x[0] for x in got if x[1] >= low]


def test_blends_keep_every_hit(spark, tmp_path):
    db = MemoryStore(spark, str(tmp_path / "b"), Config(decay_weight=0.5, connectivity_weight=0.5, auto_compact_ops=3), now=Clock())
    db.create_tenant("t"), db.create_collection("t", "c")
    db.remember_many("t", "c", [{"key": k, "text": f"oracle {k}"} for k in ("a", "b")])
    assert db.generation > 0
    assert {i["id"] for i in db.build_context("t", "oracle", 500)["items"]} == {"a", "b"}
    with pytest.raises(ValueError):
        MemoryStore(spark, str(tmp_path / "x"), Config(decay_weight=2))


def test_every_match_is_weighted_deduplicated_and_diversified(db):
    db.remember_many("acme", "support", [{"key": f"m{i:04}", "text": "oracle listener", "confidence": 0.0, "embedding": [1.0, 0.0]} for i in range(300)] + [{"key": "z", "text": "oracle listener", "confidence": 1.0, "embedding": [0.0, 1.0]}])
    assert ids(db.search(Recall("acme", "oracle", mode="text", top_k=2))) == ["z", "m0000"]
    assert ids(db.search(Recall("acme", "oracle", mode="text", top_k=2, dedup_chunks=True))) == ["z", "m0000"]
    assert ids(db.search(Recall("acme", "oracle", mode="text", top_k=2, mmr=True))) == ["z", "m0000"]
    far = ids(db.search(Recall("acme", "oracle", top_k=2, mmr=True, mmr_lambda=0.01, embedding=[1.0, 0.0])))
    assert far == ["m0000", "z"]  # the unlike one, behind 300 better ranked in both lists


def test_all_hybrid_candidates_have_the_ranks_of_the_first(spark):
    from recallforge.operators import retrieve

    d = spark.createDataFrame([(i, "oracle " * (i % 7) + "x", [1.0, i / 50]) for i in range(100)], "id long, text string, embedding array<double>")
    few, every = (retrieve.hybrid_search(d, ["oracle"], [1.0, 0.3], 10, whole=w).collect() for w in (False, True))
    every = sorted(every, key=lambda r: (-r.score, r.id))
    cols = ("id", "vector_rank", "text_rank", "score", "reason")
    assert [[r[c] for c in cols] for r in few] == [[r[c] for c in cols] for r in every[:10]] and len(every) > 80


def test_mmr_of_all_picks_as_mmr(spark):
    from recallforge.operators import retrieve

    d = spark.createDataFrame([(i, 1 / (1 + i), [None, [0.0, 0.0], [1.0, i / 9], [i / 9, 1.0]][i % 4]) for i in range(30)], "id long, score double, embedding array<double>")
    one, other = (sorted((r.place, r.id) for r in f(d, 8, 0.4).collect()) for f in (retrieve.mmr, retrieve.mmr_of_all))
    assert one == other
