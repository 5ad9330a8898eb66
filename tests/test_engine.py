import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella import errors
from tessella.engine import CancellationToken, Engine, system_probe
from tessella.functions.routing import shard_of
from tessella.operators.authority import Authority
from tessella.operators.global_index import Index, IndexPart, sample_ordinals
from tessella.operators.pages import slices
from tessella.operators.results import Budget, bound_json, json_value
from tessella.sources.catalog import ForeignKey, catalog_only, global_, sharded
from tessella.sources.importer import ImportPlan, import_sqlite
from tessella.streaming.outbox import Outbox

SHARDS = 4


def key_for(shard: int) -> int:
    return next(k for k in range(1, 1000) if shard_of(k, SHARDS) == shard)


KEYS = [key_for(s) for s in range(SHARDS)]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "db")


def events(spark, root, strict=False):
    engine = Engine(spark, root, SHARDS, strict_scatter=strict)
    engine.register_tables([sharded("events", "tenant_id", "int64"), global_("settings"), catalog_only("internal")])
    engine.migrate("CREATE TABLE events(tenant_id INTEGER NOT NULL, event_id INTEGER NOT NULL, payload TEXT NOT NULL, PRIMARY KEY(tenant_id, event_id))")
    engine.migrate("CREATE TABLE settings(code TEXT PRIMARY KEY, label TEXT NOT NULL)")
    rows = [(k, n, "shared" if n == 1 else f"only-{s}") for s, k in enumerate(KEYS) for n in (1, 2)]
    engine.load("events", spark.createDataFrame(rows, "tenant_id long, event_id long, payload string"))
    return engine


def test_reads_visit_the_shards_they_need(spark, root):
    engine = events(spark, root)
    every = engine.query("SELECT tenant_id, event_id, payload FROM events")
    assert every.shards == [0, 1, 2, 3] and every.frame.count() == 8
    one = engine.query("SELECT * FROM events WHERE tenant_id = ?1", [KEYS[2]])
    assert one.shards == [2] and {r.tenant_id for r in one.frame.collect()} == {KEYS[2]}
    assert len(one.frame.inputFiles()) == 1
    two = engine.query("SELECT * FROM events WHERE tenant_id = ?1 OR tenant_id = ?2 OR tenant_id = ?1", [KEYS[3], KEYS[1]])
    assert two.shards == [1, 3] and two.frame.count() == 4
    none = engine.query("SELECT payload FROM events WHERE tenant_id = 1 AND tenant_id = 2")
    assert none.shards == [0] and none.frame.count() == 0 and none.frame.columns == ["payload"]
    engine.execute("INSERT INTO settings(code, label) VALUES ('a', 'A'), ('b', 'B')")
    replicated = engine.query("SELECT code FROM settings ORDER BY code")
    assert replicated.shards == [0] and replicated.frame.count() == 2
    assert engine.query("SELECT 1 + 1").frame.first()[0] == 2
    with pytest.raises(errors.PermissionDenied):
        engine.query("SELECT 1 FROM internal")
    with pytest.raises(errors.InvalidQuery):
        engine.query("SELECT nothing FROM events")
    assert engine.query("SELECT payload, payload FROM events").frame.columns == ["payload", "payload"]


def test_strict_mode_takes_rows_one_by_one(spark, root):
    engine = events(spark, root, strict=True)
    for sql in ("SELECT COUNT(*) FROM events", "SELECT tenant_id FROM events ORDER BY tenant_id", "SELECT tenant_id FROM events LIMIT 1", "SELECT DISTINCT payload FROM events", "SELECT tenant_id FROM (SELECT tenant_id FROM events) AS n"):
        with pytest.raises(errors.Unsupported):
            engine.query(sql)
    assert engine.query("SELECT COUNT(*) FROM events WHERE tenant_id = ?", [KEYS[0]]).frame.first()[0] == 2


def test_budgets(spark, root):
    engine = events(spark, root)
    read = engine.query("SELECT tenant_id AS v FROM events WHERE (tenant_id = ?1 OR tenant_id = ?2) AND event_id = 1", KEYS[:2])
    assert len(engine.collect(read, Budget(2, 76)).rows) == 2
    for budget in (Budget(1, 76), Budget(2, 75)):
        with pytest.raises(errors.LimitExceeded):
            engine.collect(read, budget)
    token = CancellationToken()
    assert token.cancel() and not token.cancel()
    with pytest.raises(errors.Cancelled):
        engine.collect(read, token=token)
    with pytest.raises(errors.DeadlineExceeded):
        engine.collect(read, timeout=0)
    result = engine.collect(read)
    assert result.as_json()["shards"] == [0, 1] and list(result.cursor()) == result.rows
    cursor = result.cursor()
    assert cursor.fetchone() == result.rows[0] and cursor.remaining == 1 and cursor.fetchall() == result.rows[1:] and cursor.fetchone() is None
    assert list(read.stream()) and json_value(float("inf")) is None and json_value(b"\1") == [1] and bound_json({"a": [1]}) == '{"a":[1]}'


def test_writes_and_constraints(spark, root):
    engine = events(spark, root)
    k = KEYS[1]
    assert engine.execute("INSERT INTO events(tenant_id, event_id, payload) VALUES (?1, 3, 'x'), (?1, 4, 'y')", [k]).rows_affected == 2
    with pytest.raises(errors.UniqueViolation):
        engine.execute("INSERT INTO events(tenant_id, event_id, payload) VALUES (?1, 3, 'z')", [k])
    with pytest.raises(errors.NotNullViolation):
        engine.execute("INSERT INTO events(tenant_id, event_id) VALUES (?1, 9)", [k])
    with pytest.raises(errors.NotNullViolation):
        engine.execute("INSERT INTO events(tenant_id, event_id, payload) VALUES (NULL, 9, 'z')")
    with pytest.raises(errors.InvalidQuery):
        engine.execute("INSERT INTO events(tenant_id, event_id, payload) VALUES (?1, 9, 'z'), (?2, 9, 'z')", [KEYS[0], KEYS[1]])
    with pytest.raises(errors.InvalidQuery):
        engine.execute("UPDATE events SET payload = 'q'")
    with pytest.raises(errors.Unsupported):
        engine.execute("UPDATE events SET tenant_id = 1 WHERE tenant_id = ?", [k])
    with pytest.raises(errors.InvalidQuery):
        engine.execute("DELETE FROM events WHERE tenant_id = ?", [k], routing_key=KEYS[2])
    assert engine.execute("INSERT OR IGNORE INTO events(tenant_id, event_id, payload) VALUES (?1, 3, 'no'), (?1, 5, 'yes')", [k]).rows_affected == 1
    assert engine.execute("INSERT OR REPLACE INTO events(tenant_id, event_id, payload) VALUES (?1, 3, 'new')", [k]).rows_affected == 1
    assert engine.execute("UPDATE events SET payload = 'up' WHERE tenant_id = ? AND event_id > 3", [k]).rows_affected == 2
    assert engine.execute("DELETE FROM events WHERE event_id = 1", routing_key=k).rows_affected == 1
    got = {(r[0], r[1]) for r in engine.query("SELECT event_id, payload FROM events WHERE tenant_id = ?", [k]).frame.collect()}
    assert got == {(2, "only-1"), (3, "new"), (4, "up"), (5, "up")}
    assert engine.count("events") == 10 and engine.shard_counts("events").count() == SHARDS
    report = engine.compact("events")
    assert report["folders_after"] <= report["folders_before"] and engine.count("events") == 10
    assert engine.inspect(1, "SELECT COUNT(*) FROM events").frame.first()[0] == 4
    assert [r.event_id for r in engine.page("events", 0, 2).collect()] == [1, 2, 2]


def test_migrations_are_idempotent(spark, root):
    engine = events(spark, root)
    before = engine.catalog.generation
    engine.migrate("CREATE TABLE settings(code TEXT PRIMARY KEY, label TEXT NOT NULL)")
    assert engine.catalog.generation == before
    with pytest.raises(errors.InvalidQuery):
        engine.migrate("CREATE TABLE settings(code TEXT PRIMARY KEY)")
    with pytest.raises(errors.FailedPrecondition):
        engine.migrate("CREATE TABLE undeclared(a INTEGER)")
    with pytest.raises(errors.InvalidArgument):
        engine.register_tables([sharded("events", "tenant_id", "int64")])
    with pytest.raises(errors.FailedPrecondition):
        Engine(spark, root, SHARDS + 1)
    assert Engine(spark, root, SHARDS).count("events") == 8


def test_transactions_and_portals(spark, root):
    engine = events(spark, root)
    k = KEYS[0]
    with engine.session() as s:
        s.execute("BEGIN")
        s.execute("DELETE FROM events WHERE tenant_id = ?", [k])
        assert s.query("SELECT COUNT(*) FROM events WHERE tenant_id = ?", [k]).rows == [(0,)]
        assert engine.query("SELECT COUNT(*) FROM events").frame.first()[0] == 8
        with pytest.raises(errors.FailedPrecondition):
            s.execute("DELETE FROM events WHERE tenant_id = ?", [KEYS[1]])
        with pytest.raises(errors.TransactionAborted):
            s.query("SELECT 1")
        s.execute("ROLLBACK")
        s.execute("BEGIN")
        s.execute("DELETE FROM events WHERE tenant_id = ?", [k])
        s.execute("COMMIT")
        assert engine.query("SELECT COUNT(*) FROM events").frame.first()[0] == 6
        p = s.prepare("p", "SELECT payload FROM events WHERE tenant_id = $1 AND event_id = $2", "postgres")
        assert s.describe(p) == [{"name": "payload", "type": "string"}]
        portal = s.bind("x", p, [KEYS[1], 2])
        assert s.execute_portal(portal).rows == [("only-1",)]
        engine.execute("UPDATE events SET payload = 'later' WHERE tenant_id = ?", [KEYS[1]])
        assert s.execute_portal(portal).rows == [("later",)]
        with pytest.raises(errors.InvalidArgument):
            engine.session().execute_portal(portal)
        with pytest.raises(errors.InvalidArgument):
            s.bind("y", p, [1])
        with pytest.raises(errors.InvalidQuery):
            s.run_batch("SELECT 1; DELETE FROM events WHERE tenant_id = 1")
        assert [r.rows for r in s.run_batch("SELECT 1; SELECT 2")] == [[(1,)], [(2,)]]
        with pytest.raises(errors.Unsupported):
            s.query("SELECT ?1", [float("nan")])
    with pytest.raises(errors.FailedPrecondition):
        s.query("SELECT 1")


def test_foreign_keys_lie_together(spark, root):
    engine = Engine(spark, root, SHARDS)
    engine.register_tables([sharded("p", "k", "int64"), global_("g")])
    with pytest.raises(errors.Unsupported):
        engine.register_tables([sharded("bad", "x", "int64", foreign=(ForeignKey(("y",), "p", ("k",)),))])
    engine.register_tables([sharded("c", "k", "int64", foreign=(ForeignKey(("k", "n"), "p", ("k", "n")), ForeignKey(("code",), "g", ("code",))))])
    engine.migrate("CREATE TABLE p(k INTEGER NOT NULL, n INTEGER NOT NULL, PRIMARY KEY(k, n)); CREATE TABLE g(code TEXT PRIMARY KEY); CREATE TABLE c(k INTEGER NOT NULL, n INTEGER, code TEXT)")
    engine.execute("INSERT INTO g(code) VALUES ('a')")
    engine.execute("INSERT INTO p(k, n) VALUES (1, 1), (1, 2)")
    engine.execute("INSERT INTO c(k, n, code) VALUES (1, 1, 'a'), (1, NULL, NULL)")
    for sql in ("INSERT INTO c(k, n) VALUES (1, 9)", "INSERT INTO c(k, n, code) VALUES (1, 1, 'z')", "UPDATE c SET n = 7 WHERE k = 1 AND n = 1", "DELETE FROM p WHERE k = 1 AND n = 1", "UPDATE p SET n = 5 WHERE k = 1 AND n = 1", "DELETE FROM g WHERE code = 'a'"):
        with pytest.raises(errors.ForeignKeyViolation):
            engine.execute(sql)
    assert engine.execute("DELETE FROM p WHERE k = 1 AND n = 2").rows_affected == 1
    assert engine.execute("UPDATE c SET n = NULL WHERE k = 1").rows_affected == 2 and engine.execute("DELETE FROM p WHERE k = 1").rows_affected == 1


def test_generated_ids(spark, root):
    engine = Engine(spark, root, SHARDS)
    engine.register_tables([sharded("a", "id", "int64", generated="block", generated_column="id"), sharded("b", "id", "int64", generated="range", generated_column="id")])
    engine.migrate("CREATE TABLE a(id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT)")
    engine.migrate("CREATE TABLE b(id BIGSERIAL PRIMARY KEY, v TEXT)", "postgres")
    got = [engine.execute(f"INSERT INTO {t}(v) VALUES ('x')").generated_key[1] for t in ("a", "a", "b", "b")]
    assert len(set(got)) == 4 and got[0] == 1 << 61 | 1 and got[2] & 1 << 62
    assert engine.query("SELECT v FROM a WHERE id = ?", [got[1]]).frame.count() == 1
    with pytest.raises(errors.Unsupported):
        engine.execute("INSERT INTO a(id, v) VALUES (1, 'x')")
    with pytest.raises(errors.Unsupported):
        engine.execute("INSERT INTO a(v) VALUES ('x'), ('y')")


def users(spark, root):
    engine = Engine(spark, root, SHARDS)
    engine.register_tables([sharded("users", "tenant_id", "text")])
    engine.migrate("CREATE TABLE users(tenant_id TEXT NOT NULL, email TEXT NOT NULL, age INTEGER, PRIMARY KEY(tenant_id, email))")
    rows = [(f"t{i}", f"u{i}@x", i if i % 5 else None) for i in range(40)]
    engine.load("users", spark.createDataFrame(rows, "tenant_id string, email string, age long"))
    return engine


def test_indexes_route_and_prune_but_never_hide(spark, root):
    engine = users(spark, root)
    engine.indexes.create(Index("by_email", "users", (IndexPart("email"),)))
    engine.indexes.create(Index("by_age", "users", (IndexPart("age", True),), partitions=2))
    engine.indexes.create(Index("by_both", "users", (IndexPart("email"), IndexPart("age"))))
    for where in ("email = 'u7@x'", "email IN ('u7@x', 'u8@x', NULL)", "email = 'nobody'", "age > 35", "age BETWEEN 3 AND 4", "age < 0", "age = 7 OR age = 9", "email IN ('u1@x', 'u2@x') AND age = 2", "tenant_id = 't3' AND email IN ('u3@x', 'u4@x')", "age IS NULL", "age >= 11 AND age < 12"):
        plan = engine.plan(f"SELECT email FROM users WHERE {where}")
        found = {r[0] for r in engine.query(f"SELECT email FROM users WHERE {where}").frame.collect()}
        rows = engine.rows(engine.catalog.tables["users"])
        assert found == {r[0] for r in rows.where(where.replace("NULL)", "'')")).select("email").collect()}, where
        assert plan.shards is None or len(plan.shards) <= SHARDS
    assert engine.plan("SELECT 1 FROM users WHERE email = 'u7@x'").shards == [shard_of("t7", SHARDS)]
    miss = engine.plan("SELECT 1 FROM users WHERE email = 'nobody'")
    assert miss.index == "empty" and miss.targets(SHARDS) == [0]
    assert engine.plan("SELECT 1 FROM users WHERE age > 1000").shards == []
    assert set(engine.plan("SELECT 1 FROM users WHERE age > 1000").pruned.values()) <= {"maximum_below_lower_bound", "minimum_above_upper_bound", "empty_summary"}
    assert engine.indexes.validate("by_age").count() == 0
    key = engine.indexes.keys(engine.indexes.get("by_email").index, [("new@x",)])[0]
    authority = Authority(engine, "by_email")
    op = bytes(16)
    assert authority.reserve(op, key, 2) == "pending" == authority.reserve(op, key, 2)
    assert engine.plan("SELECT 1 FROM users WHERE email = 'new@x'").shards == [2]
    with pytest.raises(errors.UniqueViolation):
        authority.reserve(bytes(15) + b"\1", key, 1)
    assert authority.rollback(op) == "rolled_back"
    with pytest.raises(errors.FailedPrecondition):
        authority.finalize(op)
    assert engine.plan("SELECT 1 FROM users WHERE email = 'new@x'").shards == []
    one, two = authority.lease(bytes(15) + b"\2", "s", 10), authority.lease(bytes(15) + b"\3", "s", 5)
    assert (one.first, one.last, two.first) == (1, 10, 11) and authority.transition(bytes(15) + b"\2", "consumed").state == "consumed"


def test_sync_indexes_follow_writes_and_async_ones_are_uncertain(spark, root):
    engine = users(spark, root)
    engine.indexes.create(Index("now", "users", (IndexPart("email"),)))
    engine.indexes.create(Index("late", "users", (IndexPart("age"),), mode="async"))
    engine.execute("INSERT INTO users(tenant_id, email, age) VALUES ('t1', 'fresh@x', 999)")
    shard = shard_of("t1", SHARDS)
    assert engine.plan("SELECT 1 FROM users WHERE email = 'fresh@x'").candidates == [shard]
    late = engine.plan("SELECT 1 FROM users WHERE age = 999")
    assert late.uncertain == [shard] and late.shards == [shard]
    box = Outbox(engine, "late")
    assert box.behind() == [shard] and box.process() == 1 and box.process() == 0 and box.behind() == []
    assert engine.plan("SELECT 1 FROM users WHERE age = 999").candidates == [shard]
    assert engine.indexes.validate("late").count() == 0 and engine.indexes.validate("late", sample=7).count() == 0
    engine.execute("UPDATE users SET age = 5 WHERE tenant_id = 't1' AND email = 'fresh@x'")
    engine.execute("DELETE FROM users WHERE tenant_id = 't2'")
    box.process()
    assert engine.indexes.validate("late").count() == 0 and box.prune() >= 1
    box.pause()
    assert box.behind() == [0, 1, 2, 3] and box.process() == 0
    with pytest.raises(errors.FailedPrecondition):
        box.apply(box.log(), fence=0)
    assert [r.outcome for r in engine.indexes.verify("now", [("fresh@x",)]).collect()] == ["verified"]
    assert engine.indexes.lookup("now", [("u7@x",), ("fresh@x",)]).count() == 2
    assert {r.health for r in engine.indexes.status().collect()} == {"healthy", "degraded"}


def test_index_lifecycle(spark, root):
    engine = users(spark, root)
    with pytest.raises(errors.UniqueViolation):
        engine.load("users", spark.createDataFrame([("zz", "u1@x", 1)], "tenant_id string, email string, age long"))
        engine.indexes.create(Index("unique_email", "users", (IndexPart("email"),), unique=True))
    assert engine.indexes.get("unique_email").state == "failed"
    engine.execute("DELETE FROM users WHERE tenant_id = 'zz'")
    assert engine.indexes.rebuild("unique_email").state == "ready"
    with pytest.raises(errors.FailedPrecondition):
        engine.indexes.repair("unique_email")
    s = engine.indexes.create(Index("some", "users", (IndexPart("age"),), predicate="age > 30"))
    assert engine.indexes.entries(s).count() == 8 and engine.plan("SELECT 1 FROM users WHERE age = 33").index == "not_applicable"
    gone = next(iter(s.entries))
    s.entries.pop(gone)
    engine.indexes._put(s)
    assert {r.issue for r in engine.indexes.validate("some").collect()} == {"missing_entry"}
    assert engine.indexes.repair("some") == 1 and engine.indexes.validate("some").count() == 0
    everywhere = engine.indexes.create(Index("plain", "users", (IndexPart("age"),)))
    k = next(iter(everywhere.entries))
    age = next(r.age for r in engine.store.read(engine.catalog.tables["users"], [k]).collect() if r.age is not None)
    other = next(p for n, p in everywhere.entries.items() if n != k)
    everywhere.entries[k] = other.rsplit("/", 1)[0] + f"/_shard={k}"
    wrong = engine.indexes.entries(everywhere, [k]).withColumn("locator", F.lit(b"BIDX gone")).withColumn("_part", F.lit(0))
    wrong.write.partitionBy("_shard", "_part").parquet(f"{root}/wrong")
    everywhere.entries[k] = f"{root}/wrong/_shard={k}"
    engine.indexes._put(everywhere)
    assert {r.outcome for r in engine.indexes.verify("plain", [(age,)]).collect()} == {"missing_row"}
    assert engine.indexes.checked_lookup("plain", [(age,)]).count() == 1
    assert engine.indexes.repair_noted("plain") == 1 and engine.indexes.repair_noted("plain") == 0
    assert {r.outcome for r in engine.indexes.verify("plain", [(age,)]).collect()} == {"verified"}
    engine.indexes.drop("some")
    with pytest.raises(errors.InvalidArgument):
        engine.indexes.get("some")
    assert sample_ordinals(10, 4) == [0, 3, 6, 9] and sample_ordinals(3, 5) == [0, 1, 2] and sample_ordinals(9, 1) == [0]


def test_unique_keys_of_two_writers(spark, root):
    """Both wrote their rows before either published: one wins, the other publishes nothing and leaves no reservation."""
    engine = users(spark, root)
    engine.indexes.create(Index("mails", "users", (IndexPart("email"),), unique=True))
    other, publish, outcome = Engine(spark, root, SHARDS), engine.store.publish, []

    def late(table, before, folders):
        try:
            other.execute("INSERT INTO users(tenant_id, email, age) VALUES ('t5', 'one@x', 2)")
            outcome.append("other won")
        except errors.EngineError as e:
            outcome.append(type(e).__name__)
        return publish(table, before, folders)

    engine.store.publish = late
    engine.execute("INSERT INTO users(tenant_id, email, age) VALUES ('t1', 'one@x', 1)")
    assert outcome == ["UniqueViolation"]  # the first writer's reservation holds the key while it publishes
    engine.store.publish = publish
    rows = engine.query("SELECT tenant_id FROM users WHERE email = 'one@x'").frame.collect()
    assert [r[0] for r in rows] == ["t1"] and engine.indexes.validate("mails").count() == 0
    with pytest.raises(errors.UniqueViolation):
        other.execute("UPDATE users SET email = 'one@x' WHERE tenant_id = 't6'")
    assert other.execute("UPDATE users SET email = 'one@x', age = 3 WHERE tenant_id = 't1' AND email = 'one@x'").rows_affected == 1
    _, x = Authority(engine, "mails").at.read()
    assert {r["state"] for r in x["reservations"].values()} <= {"finalized", "rolled_back"}


def test_located_reads_and_partial_rewrites(spark, root):
    engine = users(spark, root)
    engine.indexes.create(Index("by_email", "users", (IndexPart("email"),), partitions=4))
    read = engine.query("SELECT tenant_id, age FROM users WHERE email IN ('u7@x', 'u8@x')")
    plan = read.frame._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in read.frame.collect()} == {"t7", "t8"} and "In(tenant_id, [t7,t8])" in plan
    table, shard = engine.catalog.tables["users"], shard_of("t7", SHARDS)
    engine.execute("INSERT INTO users(tenant_id, email, age) VALUES ('t7', 'more@x', 1)")
    before = engine.store.snapshot(table).folders[shard]
    engine.execute("UPDATE users SET age = 2 WHERE tenant_id = 't7' AND email = 'more@x'")
    after = engine.store.snapshot(table).folders[shard]
    assert before[0] in after and len(set(after) - set(before)) == 1  # the loaded files stay, the inserted one is written anew
    engine.execute("DELETE FROM users WHERE tenant_id = 't7' AND email = 'more@x'")
    assert engine.count("users") == 40 and engine.indexes.validate("by_email").count() == 0
    assert engine.query("SELECT age FROM users WHERE email = 'more@x'").frame.count() == 0


def test_attached_tables_are_read_only_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("unused")).write.parquet(path)
    engine = Engine(spark, shards=SHARDS)
    engine.attach(sharded("t", "k", "int64"), path)
    read = engine.query("SELECT v FROM t WHERE k = 5")
    plan = read.frame._jdf.queryExecution().executedPlan().toString()
    assert read.shards == [shard_of(5, SHARDS)] and read.frame.collect()[0][0] == 5
    assert "EqualTo(k,5)" in plan and "unused" not in plan.split("ReadSchema")[1]
    with pytest.raises(errors.ReadOnly):
        engine.execute("DELETE FROM t WHERE k = 5")
    assert engine.shard_counts("t").agg(F.sum("rows")).first()[0] == 100
    with engine:
        pass
    with pytest.raises(errors.ShuttingDown):
        engine.query("SELECT 1")


def test_import_of_a_sqlite_file(spark, tmp_path):
    source, target = str(tmp_path / "s.db"), str(tmp_path / "imported")
    db = sqlite3.connect(source)
    db.executescript("CREATE TABLE e(k INTEGER NOT NULL, v TEXT, f REAL, b BLOB, PRIMARY KEY(k)); CREATE TABLE g(code TEXT PRIMARY KEY); CREATE TABLE m(x INTEGER)")
    rows = [(-(2**63), None, -0.0, b""), (2**63 - 1, "a\0b", 1.25, b"\0\xff"), (7, "é", None, None)]
    db.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    db.execute("INSERT INTO g VALUES ('one')")
    db.commit()
    plan = ImportPlan.from_json(json.dumps({"version": 1, "tables": [{"name": "e", "placement": "sharded", "shard_key": {"column": "k", "key_type": "int64"}}, {"name": "g", "placement": "global"}, {"name": "m", "placement": "catalog"}]}))
    assert import_sqlite(spark, source, target, plan, SHARDS) == {"e": 3, "g": 1}
    engine = Engine(spark, target, SHARDS)
    got = {tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in engine.query("SELECT * FROM e").frame.collect()}
    assert got == set(rows)
    with pytest.raises(errors.FailedPrecondition):
        import_sqlite(spark, source, target, plan, SHARDS)
    with pytest.raises(errors.InvalidArgument):
        import_sqlite(spark, source, target + "2", ImportPlan(plan.tables[:1]), SHARDS)


def test_small_things(spark):
    assert slices([5, 0, 3], 4, 3) == [(0, 4, 1), (2, 0, 2)] and slices([5, 5], 20, 5) == []
    assert system_probe(spark, "SELECT version()").count() == 1 and system_probe(spark, "SHOW server_version").first()[0].startswith("14.")
    with pytest.raises(errors.Unsupported):
        system_probe(spark, "SELECT pg_sleep(1)")
    assert len(errors.KINDS) == 25 and errors.Busy.retryable and issubclass(errors.UniqueViolation, errors.IntegrityError)
