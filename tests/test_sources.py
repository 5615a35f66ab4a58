import json

import pytest

from lattica.operators import threats
from lattica.operators.schema import EDGES, NODES
from lattica.plans import analysis
from lattica.sources import config, graph_json, sinks, terraform

ROOT = '''
# a comment
variable "name" {
  type    = string
  default = "shop"
}
variable "open" { default = true }
locals {
  bucket = "${var.name}-data" // tail
  tags   = { Team = "x" }
}
resource "aws_s3_bucket" "data" {
  bucket = local.bucket
}
resource "aws_internet_gateway" "gw" {}
resource "aws_route_table" "rt" {
  route {
    cidr_block = "0.0.0.0/0"
    gateway_id = aws_internet_gateway.gw.id
  }
}
resource "aws_subnet" "front" {
  cidr_block = cidrsubnet("10.0.0.0/16", 8, 1)
}
resource "aws_route_table_association" "a" {
  route_table_id = aws_route_table.rt.id
  subnet_id      = "${aws_subnet.front.id}"
}
resource "aws_security_group" "web" {
  ingress {
    from_port   = 80
    cidr_blocks = ["10.0.0.0/8", "0.0.0.0/0"]
  }
}
resource "aws_instance" "vm" {
  depends_on = [aws_s3_bucket.data]
  subnet_id  = aws_subnet.front.id
  vpc_security_group_ids = [aws_security_group.web.id]
  user_data = <<-EOT
    bucket = "not an argument"
  EOT
  environment {
    variables = {
      TARGET_BUCKET = "shop-data"
      names = [for x in [1, 2] : "n-${x}"]
    }
  }
  tags = merge(local.tags, { Name = "vm" })
}
'''
MODULE = 'variable "name" { default = "other" }\nvariable "depth" { default = 3 }\nvariable "none" {}\n'


def blocks(spark, tmp_path):
    (tmp_path / "one/modules/m").mkdir(parents=True)
    (tmp_path / "one/sub").mkdir()
    (tmp_path / "one/main.tf").write_text(ROOT)
    (tmp_path / "one/cut.tf").write_text('resource "aws_x" "y" {\n a = 1\n')
    (tmp_path / "one/modules/m/v.tf").write_text(MODULE)
    (tmp_path / "one/sub/not_read.tf").write_text('resource "aws_x" "z" {}')
    (tmp_path / "one/empty.tf").write_text("")
    read = terraform.read_blocks(spark, [str(tmp_path)])
    assert read.where("error IS NOT NULL").count() == 1
    return terraform.with_project(read, spark.createDataFrame([(f"{tmp_path}/one/",)], "root string"))


def test_configuration_files(spark, tmp_path):
    b = blocks(spark, tmp_path)
    v = {x["name"]: x["value"] for x in terraform.variables(b).collect()}
    assert v == {"name": "shop", "open": "true", "depth": "3"}
    assert {x["name"]: x["value"] for x in terraform.local_values(b).collect()} == {"bucket": "${var.name}-data"}
    assert [tuple(x)[1:] for x in terraform.local_items(b).orderBy("name", "key").collect()] == [("tags", "Team", "x")]
    r = terraform.resources(b)
    of = lambda name: {x["key"]: x["value"] for x in r.where(f"resource_name = '{name}'").collect()}
    assert of("gw") == {None: None}
    assert of("rt") == {"route[0].cidr_block": "0.0.0.0/0", "route[0].gateway_id": "${aws_internet_gateway.gw.id}"}
    vm = of("vm")
    assert vm["environment[0].variables.TARGET_BUCKET"] == "shop-data" and vm["user_data"].strip() == 'bucket = "not an argument"'
    assert vm["environment[0].variables.names"].startswith("${[for") and vm["tags"].startswith("${merge(")
    assert of("web") == {"ingress[0].from_port": "80", "ingress[0].cidr_blocks[0]": "10.0.0.0/8", "ingress[0].cidr_blocks[1]": "0.0.0.0/0"}
    nodes, edges, _ = terraform.as_graph(r)
    name = {x["node_id"]: x["resource_name"] for x in nodes.collect()}
    assert {(name[x["src"]], name[x["dst"]]) for x in edges.collect()} == {("rt", "gw"), ("a", "rt"), ("a", "front"), ("vm", "front"), ("vm", "web")}


def test_module_sources(spark, tmp_path):
    files = {
        "one/main.tf": 'module "a" { source = "./parts/a" }\nmodule "b" { source = "../shared" }\nmodule "c" { source = "hashicorp/x/aws" }\nmodule "d" { source = "" }\nvariable "v" { default = "root" }',
        "one/unread/x.tf": 'resource "aws_x" "unread" {}',
        "one/parts/a/m.tf": 'module "deep" { source = "deep" }\nvariable "v" { default = "part" }\nresource "aws_x" "a" {}',
        "one/parts/a/deep/m.tf": 'module "back" { source = "../../../" }\nmodule "again" { source = "../../../../shared/." }\nresource "aws_x" "deep" {}',
        "shared/m.tf": 'resource "aws_x" "shared" {\n n = 1\n}',
        "two/main.tf": 'module "s" { source = "../shared" }\nresource "aws_x" "two" {}',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    read = terraform.read_blocks(spark, [str(tmp_path)])
    got = terraform.with_sources(read, spark.createDataFrame([(f"{tmp_path}/one/",), (f"{tmp_path}/two",), (f"{tmp_path}/three",)], "root string"))
    names = sorted((x["path_id"].rsplit(".")[-1], x["name"], x["in_module"]) for x in got.where("kind = 'resource'").collect())
    assert names == [("one", "a", True), ("one", "deep", True), ("one", "shared", True), ("two", "shared", True), ("two", "two", False)]
    assert [x["value"] for x in terraform.variables(got).collect()] == ["root"]
    nothing = read.where("false")
    assert terraform.with_sources(nothing, spark.createDataFrame([], "root string")).count() == 0


PROFILE = {
    "processes": [{"group_name": "VirtualMachine", "annotation": "VirtualMachine", "members": [{"name": "EC2", "tf_name": "aws_instance", "compress": True}]}, {"group_name": "Firewall", "annotation": "CloudApplication", "members": [{"name": "SG", "tf_name": r"aws_security_group\w*"}]}],
    "boundaries": [{"group_name": "Subnet", "members": [{"name": "Subnet", "tf_name": "aws_subnet"}]}],
    "data_stores": [{"group_name": "Storage", "members": [{"name": "S3", "tf_name": r"aws_s3_\w*", "compress": True}]}],
    "external_entities": [{"name": "User", "annotation": "RemoteUser"}],
}
RULES = {"relations": {"own": [{"id": "vm2subnet", "first_node": "Subnet", "second_node": "VirtualMachine", "method": "Backward"}]}}
CATALOG = """<?xml version="1.0" encoding="UTF-8"?>
<catalog><threat name="Tampering: store" description="d"><threatpattern name=""><patterns>pattern P(ee: DataStore, p: Process, df:DataFlow ) {
 DataFlow.sender(df, p); DataFlow.recipient(df, ee); }</patterns><mapping key="location" value="ee"/><mapping key="flow" value="df"/></threatpattern></threat>
<threat name="Other: attack" description="d"><threatpattern name=""><patterns>pattern Q(ee: ExternalEntity, p: Process, df:DataFlow ) {
 ModelElementAnnotation(a1); ModelElementAnnotation.value(a1, &quot;VirtualMachine&quot;); Process.annotations(p, a1);
 ModelElementAnnotation(a2); ModelElementAnnotation.value(a2, &quot;RemoteUser&quot;); ExternalEntity.annotations(ee, a2);
 DataFlow.sender(df, ee); DataFlow.recipient(df, p); }</patterns><mapping key="location" value="p"/></threatpattern></threat></catalog>"""


def test_from_files_to_threats(spark, tmp_path):
    import yaml

    (tmp_path / "profile.yaml").write_text(yaml.safe_dump(PROFILE))
    (tmp_path / "catalog.xml").write_text(CATALOG)
    profile, rules = config.read_profile(spark, str(tmp_path / "profile.yaml")), config.rules(spark, RULES)
    patterns = config.read_catalog(spark, str(tmp_path / "catalog.xml"))
    assert {tuple(x) for x in patterns.collect()} == {("Tampering: store", "Tampering", "Process", None, "DataStore", None, "recipient"), ("Other: attack", "Other", "ExternalEntity", "RemoteUser", "Process", "VirtualMachine", "recipient")}
    b = blocks(spark, tmp_path)
    nodes, edges, props = terraform.as_graph(terraform.resources(b))
    p = analysis.Project.of(nodes, edges, props)
    bindings = terraform.variables(b).select("path_id", "scope", "name", "value").unionByName(terraform.local_values(b))
    more = analysis.resolve_implicit(p, bindings, ghost=True)
    counts = {x["method"]: x["n_edges"] for x in analysis.link_counts(more.edges).collect()}
    assert counts["implicit_exact_match"] == 1 and counts["explicit"] == 5
    d = analysis.diagram(more, profile, rules, config.external_entities(spark, PROFILE))
    kinds = {x["name"]: x["kind"] for x in d.elements.collect()}
    assert kinds == {"VirtualMachine (EC2) - aws_instance.vm": "Process", "Firewall (SG) - aws_security_group.web": "Process", "Storage (S3) - aws_s3_bucket.data": "DataStore", "Subnet (Subnet)": "TrustBoundary", "User": "ExternalEntity"}
    assert d.placed.count() == 1
    found = threats.elicit(d.flows, patterns)
    assert {(x["threat"], x["element"]) for x in found.collect()} == {("Tampering: store", "Storage (S3) - aws_s3_bucket.data"), ("Other: attack", "VirtualMachine (EC2) - aws_instance.vm")}
    sinks.write_threats(found, f"{tmp_path}/threats")
    assert spark.read.option("header", True).csv(f"{tmp_path}/threats").count() == 2
    lines = sinks.dot_lines(d.elements, d.placed, d.flows)
    assert lines.where("part = 1").count() == 5 + 1 + d.flows.count()
    sinks.write_dot(lines, f"{tmp_path}/dot")
    folder = next((tmp_path / "dot").glob("path_id=*"))
    whole = "".join(f.read_text() for f in sorted(folder.glob("part-*"))).splitlines()
    assert (whole[0], whole[-1], len(whole)) == ("digraph {", "}", 5 + 1 + d.flows.count() + 2)
    sinks.write_model(sinks.model_rows(d.elements, d.placed, d.flows), f"{tmp_path}/model")
    assert spark.read.format("xml").option("rowTag", "element").load(f"{tmp_path}/model").count() == 5 + d.flows.count()
    sinks.replace_projects(found, f"{tmp_path}/kept")
    other = found.selectExpr("'other' AS path_id", "threat", "stride", "location", "element", "flow")
    sinks.replace_projects(other, f"{tmp_path}/kept")
    assert spark.read.parquet(f"{tmp_path}/kept").select("path_id").distinct().count() == 2


def test_public_subnets_and_exposure(spark, tmp_path):
    from lattica.operators import exposure

    nodes, edges, props = terraform.as_graph(terraform.resources(blocks(spark, tmp_path)))
    assert [x["resource_name"] for x in exposure.public_subnets(nodes, props).collect()] == ["front"]
    t = nodes.selectExpr("*", "true AS tagged", "'processes' AS section")
    hit = exposure.exposed_by(t, edges, exposure.public_groups(t, props))
    assert [x["resource_name"] for x in nodes.join(hit, "node_id", "left_semi").collect()] == ["vm"]


def test_graph_documents(spark):
    doc = {"nodes": [{"data": {"id": "1", "label": "aws_s3_bucket.b", "type": "resource", "attributes": {"a": {"b": 1}}}, "classes": ["x"]}, {"data": {"id": "2", "label": "v", "type": "var"}}], "edges": [{"data": {"id": "e", "source": "1", "target": "2"}}, {"data": {"id": "f", "source": "1", "target": "9"}}]}
    rows = [("p", json.dumps(doc)), ("q", json.dumps({"nodes": [], "edges": None})), ("r", "not json")]
    nodes, edges, attributes, dangling = graph_json.load(spark.createDataFrame(rows, "path_id string, document string"))
    assert {(x["resource_type"], x["resource_name"], x["node_type"], tuple(x["labels"])) for x in nodes.collect()} == {("aws_s3_bucket", "b", "resource", ("p", "resource")), ("v", "", "var", ("p", "var", "Variable"))}
    assert edges.count() == 1 and [x["n_dangling"] for x in dangling.collect()] == [1]
    assert [(x["key"], x["value"]) for x in graph_json.flatten(attributes, ["path_id", "node_id"]).collect()] == [("a.b", "1")]


def test_deep_nesting_and_repeated_nodes(spark):
    v = "1"
    for _ in range(40):
        v = '{"a":' + v + "}"
    deep = spark.createDataFrame([(1, v)], "node_id long, s string").selectExpr("node_id", "parse_json(s) AS v")
    assert [(x["key"], x["value"]) for x in graph_json.flatten(deep, ["node_id"]).collect()] == [(".".join("a" * 40), "1")]
    twice = {"nodes": [{"data": {"id": "1", "label": k, "type": "resource"}} for k in ("b.x", "a.y")], "edges": []}
    nodes = graph_json.load(spark.createDataFrame([("p", json.dumps(twice))], "path_id string, document string"))[0]
    assert [x["name"] for x in nodes.collect()] == ["a.y"]


def test_threat_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"id": "t", "metadata": {"ns:textName": "n"}, "context": {"ns:hasAffectedComponent": ["su:comp_App"]}, "security": {"ns:hasAggressor": ["su:comp_User", "su:comp_Service"], "ns:hasSTRIDE": ["ns:STRIDE_Tampering"]}}))
    d = config.read_threat_documents(spark, f"{tmp_path}/t.json")
    assert [tuple(x)[3:] for x in d.collect()] == [(["User", "Service"], ["App"], ["Tampering"])]
    assert threats.fan_out(d).count() == 1 and threats.fan_out(d, full_product=True).count() == 2
    sinks.catalog_xml(threats.fan_out(d), f"{tmp_path}/c")


def catalog_of(tmp_path, name, text, at="p"):
    (tmp_path / f"{name}.xml").write_text(f'<catalog><threat name="T: {name}"><threatpattern name=""><patterns>{text.replace(chr(34), "&quot;")}</patterns><mapping key="flow" value="df"/><mapping key="location" value="{at}"/></threatpattern></threat></catalog>')
    return f"{tmp_path}/{name}.xml"


def test_catalog_patterns(spark, tmp_path):
    head, ends = "pattern P(p: Process, df: DataFlow, ee: DataStore) {", "DataFlow.recipient(df, ee); DataFlow.sender(df,p);"
    note = 'ModelElementAnnotation(a); ModelElementAnnotation.value(a, "http://x, y"); Process.annotations(p, a);'
    read = lambda name, text, at="p": [tuple(x) for x in config.read_catalog(spark, catalog_of(tmp_path, name, text, at)).collect()]
    assert read("plain", f"{head} {ends} }}") == [("T: plain", "T", "Process", None, "DataStore", None, "sender")]
    assert read("note", f"{head}\n/* first */ {note} // then\n {ends} {ends} }}", "ee") == [("T: note", "T", "Process", "http://x, y", "DataStore", None, "recipient")]
    bad = {
        "negated": f"{head} neg find other(p); {ends} }}",
        "unequal": f"{head} p != ee; {ends} }}",
        "cut": f"{head} {ends}",
        "no_sender": f"{head} DataFlow.recipient(df, ee); }}",
        "two_flows": f"{head} DataFlow.recipient(df, ee); DataFlow.sender(dg, p); }}",
        "two_notes": f"{head} {note} {note.replace('(a', '(b').replace(', a)', ', b)')} {ends} }}",
        "note_without_value": f"{head} ModelElementAnnotation(a); Process.annotations(p, a); {ends} }}",
        "note_of_another": f"{head} {note.replace('(p,', '(q,')} {ends} }}",
        "untyped": f"pattern P(ee: DataStore, df: DataFlow) {{ {ends} }}",
        "no_flow": f"{head.replace('DataFlow', 'Process')} {ends} }}",
        "empty": "",
    }
    for name, text in bad.items():
        with pytest.raises(ValueError, match=name):
            read(name, text)
    with pytest.raises(ValueError, match="place"):
        read("elsewhere", f"{head} {ends} }}", "df")
    (tmp_path / "none.xml").write_text("<catalog></catalog>")
    assert config.read_catalog(spark, f"{tmp_path}/none.xml").count() == 0


def test_scanner_findings(spark, tmp_path):
    found = [{"path": f"/srv/{p}/main.tf", "extra": {"metavars": {"$NET": {"abstract_content": n}, "$OTHER": {"abstract_content": "x"}}}} for p, n in (("one", "front"), ("one", "front"), ("two", "edge"))]
    (tmp_path / "scan.json").write_text(json.dumps({"results": found, "errors": []}, indent=1))
    got = config.read_findings(spark, f"{tmp_path}/scan.json", ["$NET"])
    assert sorted(tuple(x) for x in got.collect()) == [("srv.one", "$NET", "front"), ("srv.two", "$NET", "edge")]
    assert config.read_findings(spark, f"{tmp_path}/scan.json").count() == 4


def test_empty_projects(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    p = analysis.Project.of(nodes, edges, spark.createDataFrame([], "path_id string, node_id long, key string, value string"))
    bindings = spark.createDataFrame([], "path_id string, scope string, name string, value string")
    found = analysis.analyse(p, config.profile(spark, PROFILE), config.rules(spark, RULES), config.external_entities(spark, PROFILE), spark.createDataFrame([], "threat string, stride string, sender_type string, sender_anno string, recipient_type string, recipient_anno string, location_end string"), bindings)
    assert found.count() == 0
