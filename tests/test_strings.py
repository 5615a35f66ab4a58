import random

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import match, resolve
from lattica.sources import graph_json


def test_constants_are_put_in(spark):
    b = [("var", "project_name", "phoenix"), ("var", "environment", "production"), ("var", "region_short_code", "us1"), ("var", "billing_id", "999"), ("local", "full", "${var.project_name}-${var.environment}"), ("local", "logs", "${local.full}-logs"), ("local", "a", "${local.b}"), ("local", "b", "${local.a}")]
    bindings = spark.createDataFrame([("p", *x) for x in b], "path_id string, scope string, name string, value string")
    known = resolve.resolve_bindings(bindings)
    values = {x["name"]: x["value"] for x in known.collect()}
    assert values["logs"] == "phoenix-production-logs" and values["a"] == "${local.b}" and values["b"] == "${local.a}"
    cases = {
        "${var.project_name}": "phoenix",
        "queue-${var.region_short_code}-high-priority": "queue-us1-high-priority",
        "/config/${  var.environment  }/db": "/config/production/db",
        "${local.logs}": "phoenix-production-logs",
        "Billing-${var.billing_id}": "Billing-999",
        "${module.x.project_name} ${var.nobody} var.environment": "${module.x.project_name} ${var.nobody} production",
        "no $1 \\ reference": "no $1 \\ reference",
        "": "",
    }
    props = spark.createDataFrame([("p", i, "k", x) for i, x in enumerate(cases)] + [("p", 99, "k", None)], "path_id string, node_id long, key string, value string")
    got = {x["value"]: x["resolved"] for x in resolve.resolve_props(props, known).collect()}
    assert got == {**cases, None: None}


def test_constants_against_loops(spark):
    """Chains, several references, cycles, unknown names, nulls: against putting in clean values until nothing changes."""
    import re

    r = random.Random(4)
    rows = {}
    for k in range(60):
        others = [f"${{local.n{r.randrange(70)}}}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))]
        rows[f"n{k}"] = "-".join([f"v{k}", *others]) if r.random() < 0.95 else None
    rows |= {f"c{k}": f"${{local.c{k - 1}}}." if k else "x" for k in range(200)}
    rows |= {"twice": "${local.c3}${ local.c3 }", "behind": "${local.twice}!", "loop": "${local.loop}", "to_loop": "${local.loop}${local.c1}"}
    want = dict(rows)
    while True:
        clean = {k: v for k, v in want.items() if v is not None and "${" not in v}
        new = {k: v and re.sub(r"\$\{\s*local\.(\w+)\s*\}", lambda m: clean.get(m[1], m[0]), v) for k, v in want.items()}
        if new == want:
            break
        want = new
    bindings = spark.createDataFrame([("p", "local", k, v) for k, v in rows.items()], "path_id string, scope string, name string, value string")
    got = resolve.resolve_bindings(bindings).collect()
    assert {x["name"]: x["value"] for x in got} == want and len(got) == len(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_similarity(spark):
    r = random.Random(1)
    pairs = [("payment-db-prodution", "payment-db-production"), ("data_lake_logs", "data-lake-logs"), ("auth-servce", "auth-service"), ("logs-cluster", "logs-cluster-primary"), ("", ""), ("a", "")]
    pairs += [("".join(r.choices("abc-", k=r.randint(1, 12))), "".join(r.choices("abc-", k=r.randint(1, 12)))) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio(F.col("a"), F.col("b")).alias("x"), T.may_be_near(F.col("a"), F.col("b"), 0.85).alias("near")).collect()
    for x in rows:
        n = len(x["a"]) + len(x["b"])
        want = 2 * lcs(x["a"], x["b"]) / n if n else 1.0
        assert abs(x["x"] - want) < 1e-12
        assert x["near"] or want < 0.85
    assert [round(x["x"], 4) for x in rows[:4]] == [0.9756, 0.8571, 0.9565, 0.75]


def test_boundaries(spark):
    words = ["order-events-queue", "payment-db-production", "user", "-odd-"]
    symbols = spark.createDataFrame([("p", w, 100 + i, w) for i, w in enumerate(words)], "path_id string, key string, node_id long, keyword string")
    texts = ["arn:aws:sqs:us-east-1:123456789:order-events-queue", "jdbc:mysql://payment-db-production:3306/mydb", "https://superuser-dashboard.internal/login", "https://api.internal/v1/user/profile", "https://a_user.internal", "https://x/xuser/user.internal", "https://x/éuser.internal", "https://x/-odd-/y.internal", "https://x/a-odd-/y.internal", "https://x/USER"]
    values = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path_id string, node_id long, value string")
    got = {(x["src"], x["dst"] - 100) for x in match.boundary_pairs(values, symbols).collect()}
    assert got == {(0, 0), (1, 1), (3, 2), (5, 2), (6, 2), (7, 3), (9, 2)}


def test_symbols_of_any_length_against_pattern(spark):
    import re

    r = random.Random(3)
    texts = ["".join(r.choices("ab_-. \\", k=r.randint(0, 14))) for _ in range(80)]
    words = sorted({"".join(r.choices("ab-.\\", k=r.randint(1, 4))) for _ in range(12)} | {t[k : k + 9].strip() for t in texts for k in (0, 3) if len(t) > 8})
    values = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path_id string, node_id long, value string")
    symbols = spark.createDataFrame([("p", w, 1000 + k, w) for k, w in enumerate(words)], "path_id string, key string, node_id long, keyword string")
    found = {(x["src"], words[x["dst"] - 1000]) for x in match.boundary_pairs(values, symbols, only_complex=False).collect()}
    assert found == {(i, w) for i, t in enumerate(texts) for w in words if w and re.search(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])", t)}
    assert any(len(w) > 6 for _, w in found)


NODES = "path_id string, node_id long, node_type string, resource_type string, resource_name string, name string, parent_id string"
PROPS = "path_id string, node_id long, key string, value string"


def resources(spark, rows):
    return spark.createDataFrame([("p", i, "resource", t, n, f"{t}.{n}", "") for i, t, n in rows], NODES)


def test_fuzzy_links(spark):
    n = resources(spark, [(1, "aws_db_instance", "payment-db-production"), (2, "aws_s3_bucket", "data-lake-logs"), (3, "aws_instance", "web"), (4, "aws_s3_bucket", "auth-service"), (9, "aws_lambda_function", "fn"), (5, "aws_s3_bucket", "logs-cluster-primary")])
    p = spark.createDataFrame([("p", 9, "env.DB_HOST", "payment-db-prodution"), ("p", 9, "env.TARGET_BUCKET", "data_lake_logs"), ("p", 3, "tags.Name", "auth-service"), ("p", 9, "env.AUTH_HOST", "auth-servce"), ("p", 9, "log_bucket", "logs-cluster"), ("p", 9, "x", "data_lake_logs")], PROPS)
    got = {(x["src"], x["dst"], round(x["confidence"], 4)) for x in match.fuzzy_pairs(p, match.fuzzy_targets(n, p)).collect()}
    assert got == {(9, 1, 0.9756), (9, 2, 0.8571), (9, 3, 0.9565)}


def test_symbols_and_exact_links(spark):
    n = resources(spark, [(1, "aws_dynamodb_table", "payments"), (2, "aws_lambda_function", "worker"), (3, "aws_s3_bucket", "same"), (4, "aws_sqs_queue", "same")])
    p = spark.createDataFrame([("p", 1, "name", "payment-db"), ("p", 2, "env.T", "PAYMENT-DB"), ("p", 2, "env.U", "same"), ("p", 1, "self", "payment-db"), ("p", 2, "bad", "https://payment-db"), ("p", 3, "bucket", "${var.x}"), ("p", 2, "null", None)], PROPS)
    s = match.symbol_table(n, p)
    assert {(x["key"], x["node_id"]) for x in s.collect()} == {("aws_dynamodb_table.payments", 1), ("payments", 1), ("payment-db", 1), ("aws_lambda_function.worker", 2), ("worker", 2), ("aws_s3_bucket.same", 3), ("same", 3), ("aws_sqs_queue.same", 4)}
    pairs = match.exact_pairs(p, s)
    assert {(x["src"], x["dst"]) for x in pairs.collect()} == {(2, 1), (2, 3)}


def test_ghosts(spark):
    texts = {"https://api.stripe.com/v1/charges": "URL", "my-app.auth0.com": "DOMAIN", "192.168.10.55": "IP", "arn:aws:s3:::partner-data": "ARN", "arn:other:s3": None, "rule.allow": None, "var.x": None, "aws_instance.id": None, "0.0.0.0": None, "127.0.0.1": None, "x.internal": None, "f.json": None, "https://inside-bucket.s3.example": None, "": None, "${a.b.c}": None}
    rows = [("p", i, "endpoint", t) for i, t in enumerate(texts)] + [("p", 50, "description", "https://not.read.example"), ("p", 51, "k", None)]
    inside = spark.createDataFrame([("p", "inside-bucket"), ("q", "stripe")], "path_id string, inside string")
    found = match.ghosts(spark.createDataFrame(rows, PROPS), inside)
    got = {x["src"]: x["kind"] for x in found.collect()}
    want = {i: k for i, (t, k) in enumerate(texts.items()) if k}
    assert got == want
    nodes, edges = match.ghost_graph(found)
    assert nodes.count() == edges.count() == len(want)


def test_ignored_keys_at_every_level(spark):
    keys = ["ingress[0].cidr_blocks[0]", "source.endpoint", "Description", "TYPE", "a.Note.b", "endpoint", "notes", "a.sources"]
    rows = [("p", i, k, f"h{i}.example.com", False) for i, k in enumerate(keys)] + [("p", 50, "Description", "to 10.1.2.3 now", True), ("p", 51, "description", None, None)]
    found = match.ghosts(spark.createDataFrame(rows, PROPS + ", changed boolean"), spark.createDataFrame([], "path_id string, inside string"))
    assert {(x["src"], x["key"]) for x in found.collect()} == {(5, "endpoint"), (6, "notes"), (7, "a.sources"), (50, "Description")}
    plain = match.ghosts(spark.createDataFrame([r[:4] for r in rows], PROPS), spark.createDataFrame([], "path_id string, inside string"))
    assert {x["src"] for x in plain.collect()} == {5, 6, 7}
    every = match.ghosts(spark.createDataFrame([r[:4] for r in rows], PROPS), spark.createDataFrame([], "path_id string, inside string"), ignored_keys=())
    assert {x["src"] for x in every.collect()} == {*range(8), 50}


def test_flattening_skips_whole_branches(spark):
    v = spark.createDataFrame([(1, '{"a": {"Ingress": [{"b": {"c": 1}}], "d": ["x", {"e": 2}]}, "INGRESS": "y", "f": null}')], "id long, s string").select("id", F.parse_json("s").alias("v"))
    assert {(x["key"], x["value"]) for x in graph_json.flatten(v, ["id"], skip=("ingress",)).collect()} == {("a.d[0]", "x"), ("a.d[1].e", "2")}


def test_names_of_one_convention_meet_once(spark):
    """Symbols that share their opening: as many meetings as links, not each with each."""
    for n in (100, 200):
        names = [f"acme-prod-svc-{k}" for k in range(n)]
        symbols = spark.createDataFrame([("p", w, 1000 + k, w) for k, w in enumerate(names)], "path_id string, key string, node_id long, keyword string")
        values = spark.createDataFrame([("p", k, f"https://{w}.internal/{w}x") for k, w in enumerate(names)], "path_id string, node_id long, value string")
        each = values.select("path_id", F.col("node_id").alias("src"), "value", F.xxhash64("value").alias("h"))
        assert match.spans(each, symbols).count() <= 2 * n
        assert {(x["src"], x["dst"]) for x in match.boundary_pairs(values, symbols).collect()} == {(k, 1000 + k) for k in range(n)}


def test_flatten_and_collapse(spark):
    v = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}], "c": true}, "n": null, "e": {}}'), (2, "[]"), (3, '"s"')], "id long, s string").select("id", F.parse_json("s").alias("v"))
    leaves = graph_json.flatten(v, ["id"])
    assert {(x["id"], x["key"], x["value"]) for x in leaves.collect()} == {(1, "a.b[0]", "1"), (1, "a.b[1].c", "x"), (1, "a.c", "true"), (3, "", "s")}
    assert {(x["key"], x["value"]) for x in graph_json.collapse(leaves.where("id = 1"), ["id"]).collect()} == {("c", "true")}


def test_upserts_and_overlays(spark):
    rows = [("p", 3, "resource", "t", "n", "t.n", "m1"), ("p", 1, "resource", "t", "n", "t.n", "m1"), ("p", 2, "resource", "t", "n", "t.n", "m2"), ("q", 0, "resource", "t", "n", "t.n", "m1")]
    n = spark.createDataFrame(rows, NODES)
    assert {x["node_id"] for x in resolve.upsert_nodes(n).collect()} == {0, 1, 2}
    assert {x["node_id"] for x in resolve.upsert_nodes(n, across_modules=True).collect()} == {0, 1}
    a = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "own", "x")], "id long, v string, w string")
    b = spark.createDataFrame([(1, "new", None), (2, None, None), (3, "new", None)], "id long, v string, w string")
    assert {tuple(x) for x in resolve.set_if_unset(a, b, ["id"], ["v"]).collect()} == {(1, "new", "x"), (2, "", "x"), (3, "own", "x")}
    assert {tuple(x) for x in resolve.overwrite(a, b.where("id < 3"), ["id"], ["v", "w"]).collect()} == {(1, "new", None), (2, None, None), (3, "own", "x")}
    parsed = spark.createDataFrame([("p", "t", "n", "k", "v")], "path_id string, resource_type string, resource_name string, key string, value string")
    assert [tuple(x) for x in resolve.attach_props(n, parsed).collect()] == [("p", 1, "k", "v")]


def test_bindings_of_nodes(spark):
    rows = [
        ("p", "resource", "a.x", ["p", "Variable"], "1", "2"),
        ("p", "var", "x", None, None, "3"),
        ("p", "local", "local.x.y", [], None, "4"),
        ("p", "local", "other.x", ["local"], "0", None),
        ("p", "var", "nothing", ["var"], None, None),
        ("p", "resource", "res.x", ["p", "resource"], "5", None),
        ("q", "both", ".", ["var", "Local"], "6", None),
        (None, "var", None, ["var"], "7", None),
        ("p", None, "none", None, "8", None),
    ]
    nodes = spark.createDataFrame(rows, "path_id string, node_type string, name string, labels array<string>, `default` string, value string")
    got = {(x["path_id"], x["scope"], x["name"]): x["value"] for x in resolve.bindings_of(nodes).collect()}
    assert got == {("p", "var", "a.x"): "1", ("p", "var", "x"): "3", ("p", "local", "x"): "0", ("p", "local", "local.x.y"): "4", ("p", "local", "other.x"): "0", ("q", "var", "."): "6", ("q", "local", "."): "6", ("q", "var", ""): "6", ("q", "local", ""): "6"}
    assert resolve.bindings_of(nodes.where("false")).count() == 0
