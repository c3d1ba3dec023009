import random

from pyspark.sql import functions as F

from contactloom.operators import resolve
from contactloom.schemas import DATA_COLUMNS, LEADS_DDL

LISTING = "seq LONG, chamber_url STRING, name STRING, company_name STRING, website STRING, phone STRING, source_url STRING"
LEADS = LEADS_DDL.strip().replace("\n", " ").replace(" NOT NULL", "")


def listings(spark, rows):
    return spark.createDataFrame(rows, LISTING)


def test_normalized(spark):
    rows = [(1, "https://c.org", "A", "B", "a.com", "1", None), (2, "https://c.org", "", "B", "http://b.com", "", "https://s.org"), (3, None, None, None, "", None, None)]
    got = {r.seq: r for r in resolve.normalized(listings(spark, rows)).collect()}
    assert (got[1].company_name, got[1].website, got[1].canonical_url, got[1].scraped_from_url, got[1].phone_numbers) == ("A", "https://a.com", "https://a.com", "https://c.org", ["1"])
    assert (got[2].company_name, got[2].website, got[2].scraped_from_url, got[2].phone_numbers) == ("B", "http://b.com", "https://s.org", None)
    assert resolve.identified(resolve.normalized(listings(spark, rows))).count() == 2


def test_dedupe(spark):
    rows = [(3, "c", " ACME ", None, "a.com", None, None), (1, "c", "Acme", None, "A.com", None, None), (2, "d", "acme", None, "https://a.com", None, None), (4, "c", None, None, None, None, None), (5, "c", None, None, "x.com", None, None)]
    df = listings(spark, rows)
    assert sorted(r.seq for r in resolve.dedupe_by_name(df).collect()) == [1, 2, 5]
    hashed = resolve.dedupe_by_hash(resolve.identified(resolve.normalized(df)))
    assert sorted(r.seq for r in hashed.collect()) == [1, 5]
    seen = hashed.where("seq = 1").select("hash")
    assert [r.seq for r in resolve.dedupe_by_hash(resolve.identified(resolve.normalized(df)), seen=seen).collect()] == [5]


def test_matching_plans_no_nested_loop(spark):
    incoming = spark.createDataFrame([(1, "w1", "n9"), (2, None, "n1"), (3, "w2", "n1"), (4, None, None)], "seq INT, website STRING, company_name STRING")
    leads = spark.createDataFrame([(10, "w1", "n1"), (5, "w2", None), (7, "w1", None)], "id LONG, website STRING, company_name STRING")
    out = resolve.matches(incoming, leads)
    assert {r.seq: r.lead_id for r in out.collect()} == {1: 7, 2: 10, 3: 5, 4: None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def sequential(leads, incoming, update):
    """One record after another against the whole table."""
    table = [dict(x) for x in leads]
    actions = {x["id"]: "keep" for x in table}
    top = max([x["id"] for x in table], default=0)
    for r in sorted(incoming, key=lambda r: r["seq"]):
        met = [x for x in table if r["website"] is not None and x["website"] == r["website"] or r["company_name"] is not None and x["company_name"] == r["company_name"]]
        if not met:
            top += 1
            table.append({k: r[k] for k in ("website", "company_name", "description")} | {"id": top})
            actions[top] = "insert"
        elif update:
            x = min(met, key=lambda x: x["id"])
            x.update({k: r[k] for k in ("website", "company_name", "description") if r[k] is not None})
            if actions[x["id"]] == "keep":
                actions[x["id"]] = "update"
    return sorted((x["id"], x["website"], x["company_name"], x["description"], actions[x["id"]]) for x in table)


def frame(spark, rows, ids):
    key = "id" if ids else "seq"
    df = spark.createDataFrame([(r[key], r["website"], r["company_name"], r["description"]) for r in rows], f"{key} LONG, website STRING, company_name STRING, description STRING")
    types = {f.split()[0]: f.split()[1] for f in LEADS.replace(", STRING>", ";STRING>").split(", ")}
    missing = [c for c in DATA_COLUMNS if c not in df.columns]
    df = df.select("*", *[F.lit("s").alias(c) if c == "scraped_from_url" else F.lit(None).cast(types[c].replace(";", ",")).alias(c) for c in missing])
    return df.withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp")}) if ids else df


def test_upsert_against_the_sequential_model(spark):
    rng = random.Random(5)
    for k in range(3):
        pick = lambda p, n: None if rng.random() < 0.25 else f"{p}{rng.randrange(n)}"  # noqa: B023, E731
        n = 12 if k < 2 else 40
        old = [{"id": i * 3 + 1, "website": pick("w", n), "company_name": pick("n", n), "description": None} for i in range(n // 3)]
        new = [{"seq": s, "website": pick("w", n), "company_name": pick("n", n), "description": f"d{s}"} for s in rng.sample(range(1000), n)]
        new = [r for r in new if r["website"] or r["company_name"]]
        update = k != 1
        out = resolve.upsert(frame(spark, old, True), frame(spark, new, False), update)
        got = sorted((r.id, r.website, r.company_name, r.description, r.action) for r in out.collect())
        assert got == sequential(old, new, update)


def test_upsert_fold_many_cases():
    rng = random.Random(1)
    blank = dict.fromkeys(DATA_COLUMNS)
    for _ in range(2000):
        pick = lambda p: None if rng.random() < 0.3 else f"{p}{rng.randrange(4)}"
        old = [{"id": i, "website": pick("w"), "company_name": pick("n"), "description": None} for i in range(1, rng.randrange(1, 4))]
        new = [{"seq": s, "website": pick("w"), "company_name": pick("n"), "description": f"d{s}"} for s in range(rng.randrange(6))]
        new = [r for r in new if r["website"] or r["company_name"]]
        rows = [blank | x | {"seq": None, "order_": (0, x["id"])} for x in old] + [blank | x | {"id": None} for x in new]
        leads, inserts, updates, _ = resolve.fold(rows, True)
        top = max([x["id"] for x in old], default=0)
        for i, x in enumerate(x for x in leads if x["id"] is None):
            x["id"] = top + 1 + i
        got = sorted((x["id"], x["website"], x["company_name"], x["description"]) for x in leads)
        assert got == [x[:4] for x in sequential(old, new, True)]
        assert inserts + updates == len(new)


def test_counters(spark):
    df = listings(spark, [(1, None, None, None, None, None, None)] * 3)
    none = spark.createDataFrame([], "action STRING")
    assert resolve.counters(df, none, 1, 0)["errors"] == 2
    assert resolve.counters(df, spark.createDataFrame([("insert",), ("update",), ("update",)], "action STRING"), 0, 3) == {"total_attempted": 3, "successful_inserts": 1, "successful_updates": 2, "duplicates_skipped": 0, "errors": 0}
