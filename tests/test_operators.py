"""Small cases of the operators, with the results a single-file tool would give."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modelgraph import plans
from modelgraph.functions import classmodel as fn
from modelgraph.functions import render
from modelgraph.operators import classmodel, definitions, exports, extract, graph, imports, resolution, suggestions, workspace
from modelgraph.plans import texts as plans_texts
from modelgraph.plans.views import Views
from modelgraph.sources.files import read_models
from modelgraph.streaming import edits

SOURCE = """version: '1.0' # c
title: ''
import {a, b as c} from 'base.ontol'
import * from 'http://x.org/o.ontol'
types:
Parent: 'Label #1', 'A (type) :) 1) }', { color: '#102030', color: '#000000' }
Child: "", '', {
  note: "it's } # n",
}
broken line
functions:
F1: 'does' (Child: 'in1',
  Child: '') -> Parent: 'out', { type: 'inheritance' }
F2: "none # (" () -> Parent: 'x (y)'
hierarchy:
Parent composition Child
r1: Child association Parent, { direction: 'backward' }
figure "First":
Parent
r1
"""


def lines(spark, text):
    return extract.section_of_line(extract.logical_lines(spark.createDataFrame([("f", text)], "file string, content string"))).cache()


def test_statements(spark):
    x = lines(spark, SOURCE)
    assert {(r.tag, r.value) for r in extract.meta(x).collect()} == {("version", "1.0"), ("title", "")}
    assert [tuple(r)[2:] for r in extract.terms(x).orderBy("line").collect()] == [("Parent", "Label #1", "A (type) :) 1) }", "#000000", None), ("Child", "", "", None, "it's } # n")]
    f = extract.functions(x).orderBy("line").collect()
    assert [(r.name, [tuple(i) for i in r.inputs], r.output_term, r.output_label, r.type) for r in f] == [
        ("F1", [(1, "Child", "in1"), (2, "Child", "")], "Parent", "out", "inheritance"), ("F2", [], "Parent", "x (y)", None)
    ]
    found = extract.relationships(x).orderBy("line")
    assert [tuple(r) for r in found.select("name", "parent", "relationship", "child", "direction").collect()] == [(None, "Parent", "composition", "Child", None), ("r1", "Child", "association", "Parent", "backward")]
    assert [tuple(r) for r in found.select("color", "title", "leftChar", "rightChar").collect()] == [(None,) * 4] * 2
    assert [(r.figure, r.member) for r in extract.figures(x).orderBy("line").collect()] == [("First", "Parent"), ("First", "r1")]
    assert [tuple(r)[2:] for r in extract.imports(x).orderBy("line", "name").collect()] == [("base.ontol", False, "a", None), ("base.ontol", False, "b", "c"), ("http://x.org/o.ontol", True, None, None)]
    assert [r.text for r in extract.unparsed(x).collect()] == ["broken line"]


def test_golden_lines(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(render.puml_edge(lit("wheel"), lit("turn"), lit("directAssociation"), none, lit("#123456"), lit("2"), none, none)) == 'wheel "2" --[#123456]->  turn '
    assert one(render.puml_edge(lit("cart"), lit("wheel"), lit("composition"), none, none, none, none, none)) == "cart  --[#black]-*  wheel "
    assert one(render.arrow(lit("inheritance"), lit("bidirectional"), none)) == "<|-[#black]--|>"
    assert one(render.dsl_attributes(color=lit("#123456"), note=none)) == ", { color: '#123456' }"
    assert one(render.literal(lit("it's"))) == '"it\'s"' and one(render.literal(lit("a'b\"\n\\"))) == repr("a'b\"\n\\")
    assert one(workspace.slug(lit("  Схема  №1: Ёлка-Shop "))) == "shema_1_elka_shop"


def test_undefined_and_duplicates(spark):
    terms = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 6, "a")], "ontology_id long, seq long, name string")
    refs = spark.createDataFrame([(1, 2, "input", "a"), (1, 2, "input", "b"), (1, 9, "child", "zz"), (2, 9, "child", "a")], "ontology_id long, seq long, role string, term string")
    assert {(r.ontology_id, r.term) for r in definitions.undefined_references(refs, terms).collect()} == {(1, "b"), (1, "zz"), (2, "a")}
    every = terms.select(F.lit("term").alias("kind"), F.lit(0).alias("kind_order"), "ontology_id", "seq", "name")
    assert [(r.name, r.seq) for r in definitions.duplicate_declarations(every).collect()] == [("a", 6)]


def test_cycles_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("x", "y"), ("x", "z"), ("y", "w"), ("z", "w")], "a string, b string")
    assert {r.node for r in graph.on_cycles(edges).collect()} == {"a", "b", "c"}
    assert {r.node: r.chain for r in graph.cycle_chains(edges).collect()} == {"a": ["a", "b", "a"], "b": ["b", "a", "b"], "c": ["c", "c"]}
    assert ("x", "w") in {tuple(r) for r in graph.closure(edges).collect()}
    assert graph.closure(edges.limit(0)).count() == 0 == graph.on_cycles(edges.limit(0)).count()


def test_diamond_imports(spark):
    i = spark.createDataFrame([(1, 2, None), (1, 3, None), (2, 4, None), (3, 4, "base")], "file_id long, target_id long, name string")
    declared = [(f, 9, "term", n, c, []) for f, n, c in (("1", "own", "x"), ("2", "n", "1"), ("3", "n", "2"), ("4", "base", "b"), ("4", "hidden", "h"))]
    got = _resolved(spark, [("1", "2", 1, None), ("1", "3", 2, None), ("2", "4", 1, None), ("3", "4", 1, [("base", None)])], declared)
    assert len(got["1", "term", "base"]) == 1 and len(got["1", "term", "n"]) == 2 and len(got["1", "term", "hidden"]) == 1 and ("3", "term", "hidden") not in got
    ring = i.unionByName(spark.createDataFrame([(5, 5, None), (6, 5, None), (5, 1, None), (7, 8, None)], i.schema))
    assert {tuple(r)[:2] for r in imports.acyclic(ring).select("file_id", "target_id").collect()} == {(1, 2), (1, 3), (2, 4), (3, 4), (7, 8)}
    warnings = spark.createDataFrame([(1, 1), (4, 3)], "file_id long, n long")
    assert {r.file_id: r.n for r in imports.collected_warnings(i, warnings).collect()} == {1: 7, 2: 3, 3: 3, 4: 3}


def test_class_rules(spark):
    g = spark.createDataFrame([(3, 1), (3, 2)], "specific long, general long")
    a = spark.createDataFrame([(1, "x", "String"), (2, "x", None)], "class long, name string, type_ string")
    assert [tuple(r) for r in classmodel.inheritance_conflicts(g, a).collect()] == [(3, "x", 2)]
    # One of several parents may conflict with itself; a class with one parent is not checked.
    two = spark.createDataFrame([(1, "x", "String"), (1, "x", "int"), (1, "y", None), (2, "z", None)], a.schema)
    assert [tuple(r) for r in classmodel.inheritance_conflicts(g, two).collect()] == [(3, "x", 2)]
    assert classmodel.inheritance_conflicts(g.limit(1), two).isEmpty()
    ends = spark.createDataFrame([(1, 1, "w", "composition"), (1, 2, "p", "none"), (1, 3, "p", "none"), (2, 1, "w", "composition"), (2, 2, "q", "none")], "assoc_id long, end_no long, participant string, aggregation string")
    assert [tuple(r) for r in classmodel.composition_parts(ends).collect()] == [("p", 2)]
    m = spark.createDataFrame([("",), (None,), ("*",), ("2",), ("1..*",), ("0..5",), ("5..3",), ("-1",), ("x",)], "t string")
    got = {r.t: (r.m.lower, r.m.upper, r.bad) for r in m.select("t", fn.multiplicity(F.col("t")).alias("m"), fn.bad_multiplicity(F.col("t")).alias("bad")).collect()}
    assert got == {"": (0, None, False), None: (0, None, False), "*": (0, None, False), "2": (2, 2, False), "1..*": (1, None, False), "0..5": (0, 5, False), "5..3": (5, 3, True), "-1": (-1, -1, True), "x": (None, None, True)}


def test_replies(spark):
    good = 'Ok {"relationships": [{"parent": "a", "child": "b", "relationship": "inheritance", "label": null, "is_bidirectional": true, "comment": "b is a kind of a"}]} end'
    r = spark.createDataFrame([(5, 1, 1, good), (5, 2, 1, "no json"), (5, 3, 1, good.replace("inheritance", "likes")), (5, 4, 1, None), (5, 6, 1, good.replace("true", "null")), (5, 7, 1, good.replace('"label": null, ', ""))], "ontology_id long, conv_id long, turn long, reply string")
    s = suggestions.reply_relationships(r)
    terms = spark.createDataFrame([(5, "a"), (5, "b")], "ontology_id long, name string")
    assert [(x.parent, x.child, x.bidirectional) for x in suggestions.resolve(s, terms).collect()] == [("b", "a", True)]
    assert suggestions.resolve(s, terms.withColumn("ontology_id", F.lit(6).cast("long"))).count() == 0
    two = suggestions.reply_relationships(r.unionByName(r.where("conv_id = 1").withColumn("ontology_id", F.lit(9).cast("long"))))
    assert suggestions.keep_first(two).count() == 2
    taken = spark.createDataFrame([(9, "a", "b")], "ontology_id long, parent string, child string")
    assert [x.ontology_id for x in suggestions.new_only(two, taken).collect()] == [5]
    titled = suggestions.reply_relationships(r.where("conv_id = 1").withColumn("reply", F.replace("reply", F.lit("null"), F.lit('"is a"'))))
    assert suggestions.snippets(titled).first().snippet == "hierarchy:\n  # b is a kind of a\n  a inheritance b, { title: 'is a', direction: 'bidirectional' }"
    assert suggestions.snippets(s).first().snippet == "hierarchy:\n  # b is a kind of a\n  a inheritance b, { direction: 'bidirectional' }"


def test_entries(spark):
    p = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    f = spark.createDataFrame([(1, "z.ontol"), (1, "main.ontol"), (2, "b.tdl"), (2, "a.ontol"), (4, "a.ontol")], "project_id long, name string")
    w = spark.createDataFrame([(4, "nope.ontol")], "id long, entry string")
    assert {r.id: (r.entry, r.error) for r in workspace.choose_entry(p, f, w).collect()} == {1: ("main.ontol", None), 2: ("a.ontol", None), 3: (None, "Project has no files"), 4: (None, "entry not found")}


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.ontol").write_text("types:\n")
    (tmp_path / "in" / "deep" / "b.ontol").write_text("é")
    (tmp_path / "in" / "c.tdl").write_text("x")
    folder = str(tmp_path / "in")
    assert {r.content for r in read_models(spark, folder).collect()} == {"types:\n", "é"}
    q = edits.watch_sources(spark, folder).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("watched").count() == 2

    rows = [(1, "f", "2024-01-01 00:00:00.0", "a"), (1, "f", "2024-01-01 00:00:00.5", "b"), (1, "f", "2024-01-01 00:00:03", "c"), (2, "g", "2024-01-01 01:00:00", "d")]
    static = spark.createDataFrame(rows, "project_id long, name string, t string, content string").select("project_id", "name", F.to_timestamp("t").alias("ts"), "content")
    path = str(tmp_path / "edits")
    static.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(path)
    q = edits.debounced(stream).writeStream.format("memory").queryName("saves").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.project_id, r.content, r.n) for r in spark.table("saves").collect()}
    want = {(r.project_id, r.content, r.n) for r in edits.debounced(static).collect()}
    assert want == {(1, "b", 2), (1, "c", 1), (2, "d", 1)} and got <= want and (1, "b", 2) in got
    out = str(tmp_path / "files")
    edits.start_upserts(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.project_id, r.content) for r in edits.stored_files(spark, out).collect()} == {(1, "c"), (2, "d")}


def test_chains_stop_with_an_error(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    assert graph.cycle_chains(ring, most_rounds=3).count() == 3
    with pytest.raises(RuntimeError):
        graph.cycle_chains(ring, most_rounds=2)


def test_lines_keep_their_own_brackets(spark):
    text = "types:\na: 'A', 'x' # don't (\nb: 'B', 'see 1) foo'\nc: \"C\", 'l' , {\n note: '}'\n }\n(\n'open"
    got = [r.text for r in extract.logical_lines(spark.createDataFrame([("f", text)], "file string, content string")).orderBy("line").collect()]
    assert got == ["types:", "a: 'A', 'x'", "b: 'B', 'see 1) foo'", "c: \"C\", 'l' , { note: '}' }", "(", "'open"]
    long = spark.createDataFrame([("f", "t: 'x', '" + "(" * 300_000 + "'\n" + "p r q\n" * 50_000 + "{" * 100_000), ("g", None), ("h", "")], "file string, content string")
    assert extract.logical_lines(long).groupBy("file").count().collect() == [("f", 50_002)]


def _resolved(spark, statements, declared):
    """statements: (file, target, seq, [(name, alias)] or None); -> {(file, kind, name): [(place, body, parts)]}."""
    rows = [(f, t, s, k, n, a) for f, t, s, names in statements for k, (n, a) in enumerate(names if names is not None else [(None, None)])]
    i = spark.createDataFrame(rows, "file_id string, target_id string, seq int, pos int, name string, alias string")
    d = spark.createDataFrame(declared, "file_id string, seq int, kind string, name string, body string, uses array<string>")
    out = {}
    for r in resolution.resolved(i, d).collect():
        out.setdefault((r.file_id, r.kind, r.name), []).append((r.place, r.body, [tuple(p) for p in r.parts]))
    return out


def test_diamond_of_one_term_is_no_conflict_but_two_contents_are(spark):
    declared = [("d", 10, "term", "foo", "Foo", []), ("d", 11, "term", "bar", "Bar", []), ("x", 10, "term", "foo", "other", [])]
    star = lambda f, t, s: (f, t, s, None)
    got = _resolved(spark, [star("a", "b", 1), star("a", "c", 2), star("b", "d", 1), star("c", "d", 1), star("e", "d", 1), star("e", "x", 2)], declared)
    assert got["a", "term", "foo"] == [(1, "Foo", [])] and got["a", "term", "bar"] == [(1, "Bar", [])]
    assert sorted(got["e", "term", "foo"]) == [(1, "Foo", []), (2, "other", [])]


def test_functions_bring_their_terms_along_where_names_are_free(spark):
    declared = [
        ("base", 1, "term", "t", "T", []), ("base", 2, "term", "u", "U", []), ("base", 3, "function", "f", "F", ["t", "u", "late"]), ("base", 4, "term", "late", "L", []),
        ("base", 5, "relationship", "r", "composition", ["u", "t"]), ("base", 6, "relationship", None, "association", ["t", "u"]),
        ("m", 0, "term", "u", "own", []), ("m", 9, "function", "g", "G", ["t", "u"]), ("n", 9, "function", "t", "a function", []),
    ]
    got = _resolved(spark, [("m", "base", 1, [("f", None)]), ("n", "base", 1, [("t", "x"), ("f", "h"), ("gone", None)]), ("k", "n", 1, None)], declared)
    assert got["base", "function", "f"] == [(3, "F", [("t", "T"), ("u", "U"), ("late", None)])]
    # t comes along, u is taken by the importing file's own term; the function keeps its own u.
    assert got["m", "term", "t"] == [(1, "T", [])] and got["m", "term", "u"] == [(0, "own", [])]
    assert got["m", "function", "f"] == [(1, "F", [("t", "T"), ("u", "U"), ("late", None)])]
    assert got["m", "function", "g"] == [(9, "G", [("t", "T"), ("u", "own")])]
    # The alias of a term shows in the function that the same statement imports; u comes along.
    assert got["n", "term", "x"] == [(1, "T", [])] and got["n", "function", "h"] == [(1, "F", [("x", "T"), ("u", "U"), ("late", None)])]
    assert ("n", "term", "t") not in got and got["n", "term", "u"] == [(1, "U", [])]
    # All of it goes on to the next file; unnamed relationships stay where they are.
    assert got["k", "function", "h"] == got["n", "function", "h"] and ("k", "term", "u") in got and ("k", "relationship", None) not in got
    assert ("base", "relationship", None) in got


def test_a_term_that_only_an_import_declares(spark):
    i = spark.createDataFrame([("m", "base", 5, 0, "t", "x")], "file_id string, target_id string, seq int, pos int, name string, alias string")
    d = spark.createDataFrame([("base", 1, "term", "t", "T", [])], "file_id string, seq int, kind string, name string, body string, uses array<string>")
    refs = spark.createDataFrame([("m", 4, "input", "x"), ("m", 6, "input", "x"), ("m", 6, "output", "t")], "file_id string, seq int, role string, term string")
    got = resolution.undefined_references(refs, resolution.resolved(i, d)).collect()
    assert sorted((r.seq, r.term) for r in got) == [(4, "x"), (6, "t")]


def test_warnings_in_the_order_of_the_import_paths(spark):
    i = spark.createDataFrame([("a", "b", 2), ("a", "c", 4), ("b", "d", 1), ("c", "d", 7)], "file_id string, target_id string, seq int")
    w = spark.createDataFrame([("a", 1, "a1"), ("a", 3, "a3"), ("b", 5, "b5"), ("c", 5, "c5"), ("d", 1, "d1"), ("d", 2, "d2")], "file_id string, seq int, text string")
    rows = resolution.collected_warnings(i, w).where("file_id = 'a'").orderBy("at").collect()
    assert [r.text for r in rows] == ["a1", "d1", "d2", "b5", "a3", "c5", "d1", "d2"]
    with pytest.raises(RuntimeError, match="over 2 warnings"):
        resolution.collected_warnings(i, w, most_rows=2)
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "file_id string, target_id string, seq int")
    with pytest.raises(RuntimeError, match="circle"):
        resolution.collected_warnings(ring, w)


def test_import_keys(spark):
    cases = [("/m/a.ontol", "HTTP://x.org/a", "HTTP://x.org/a"), ("b.ontol", "c.ontol", "/c.ontol"), ("d/b.ontol", "../c.ontol", "/c.ontol"), ("/m/n/b.ontol", "./x/../c.ontol", "/m/n/c.ontol"), ("/m/a", "/z/./q", "/z/q"), ("/m/a", "file:c", "/m/file:c")]
    rows = spark.createDataFrame([c[:2] for c in cases], "p string, s string").select("p", "s", imports.import_key(F.col("p"), F.col("s")).alias("k"))
    assert sorted(map(tuple, rows.collect())) == sorted(cases)


def _of_source(spark, text):
    return spark.createDataFrame([("f", text)], "file string, content string")


TDL = """-- a comment with АССОЦИАЦИЯ А -- Б
класс А АБСТРАКТНЫЙ
  АТРИБУТЫ
    + x : String = "a{b КОНЕЦ КЛАСС" # y [ 1..* ] : цел = 5 { только_чтение }
    имя
  ОПЕРАЦИИ
    - f(a : int = 3, b = "x, y)", c) : B {запрос, лист}
    g() {абстрактная}
КОНЕЦ КЛАСС
ПЕРЕЧИСЛЕНИЕ Ц красный
 имя В КОНЕЦ ПЕРЕЧИСЛЕНИЕ
АССОЦИАЦИЯ
  А 1
  --
  Призрак *
  ИМЯ "связь с призраком"
КОМПОЗИЦИЯ А [0..1] : часть -- Б [2..*] : имя производная ИМЯ владеет
агрегация А -- Б
ЗАВИСИМОСТЬ А -> Б "use" ЗАВИСИМОСТЬ А -> Б call ЗАВИСИМОСТЬ А -> Б
ОБОБЩЕНИЕ Б -> А ПОДСТАНОВОЧНОЕ
РЕАЛИЗАЦИЯ Б -> А
АССОЦИАЦИЯ А [1 -- Б
РАЗМЕЩЕНИЕ
  ЗАФИКСИРОВАТЬ А В ( 80 , 80 )
КОНЕЦ РАЗМЕЩЕНИЕ
ОБОБЩЕНИЕ А -> Х
"""


def test_class_sources(spark):
    s = _of_source(spark, TDL)
    classes = extract.tdl_classes(s).cache()
    assert [(r["class"], r.is_abstract, r.stereotype) for r in classes.orderBy("pos").collect()] == [("А", True, None), ("Ц", False, "enumeration")]
    a = extract.tdl_attributes(classes).orderBy("class", "pos").collect()
    assert [(r["class"], r.visibility, r.name, r.type_, r.initial_value, r.read_only) for r in a] == [
        ("А", "+", "x", "String", "a{b КОНЕЦ КЛАСС", False), ("А", "#", "y", "цел", "5", True), ("А", None, "имя", None, None, False),
        ("Ц", None, "красный", None, None, False), ("Ц", None, "имя", None, None, False), ("Ц", None, "в", None, None, False),
    ]
    assert (a[1].multiplicity.lower, a[1].multiplicity.upper) == (1, None)
    o = extract.tdl_operations(classes).orderBy("pos").collect()
    assert [(r.visibility, r.name, [tuple(p) for p in r.params], r.return_type, r.is_abstract, r.is_query, r.is_leaf) for r in o] == [
        ("-", "f", [("a", "int", "3"), ("b", None, "x, y)"), ("c", None, None)], "B", False, True, True), (None, "g", [], None, True, False, False),
    ]
    two = extract.tdl_associations(s).orderBy("pos").drop("file", "pos").collect()
    assert [tuple(r) for r in two] == [
        ("none", "А", "1", None, "Призрак", "*", None, "связь с призраком", False),
        ("composition", "А", "0..1", "часть", "Б", "2..*", "имя", "владеет", True),
        ("aggregation", "А", None, None, "Б", None, None, None, False),
    ]
    arrows = extract.tdl_relations(s).orderBy("pos").drop("file", "pos").collect()
    assert [tuple(r) for r in arrows] == [
        ("dependency", "А", "Б", "use"), ("dependency", "А", "Б", "call"), ("dependency", "А", "Б", None), ("generalization", "Б", "А", None), ("realization", "Б", "А", None),
    ]
    assert [r.text.replace("\x01", " ") for r in extract.tdl_unparsed(s).collect()] == ["Kассоциация IА S[ N1 S-- IБ "]
    kinds = {(r.kind, r.text) for r in extract.tdl_tokens(s).collect()}
    assert {("K", "класс"), ("I", "Призрак"), ("Q", "a{b КОНЕЦ КЛАСС"), ("N", "80"), ("S", "--"), ("W", "имя")} <= kinds


def test_errors_of_class_sources(spark):
    """The kinds of errors that a model of one source can have: each is found from its text."""
    ring = _of_source(spark, "КЛАСС А КОНЕЦ КЛАСС КЛАСС Б КОНЕЦ КЛАСС КЛАСС В КОНЕЦ КЛАСС\nОБОБЩЕНИЕ Б -> А\nОБОБЩЕНИЕ В -> Б\nОБОБЩЕНИЕ А -> В")
    edges = extract.tdl_relations(ring).select(F.col("source").alias("a"), F.col("target").alias("b"))
    assert {r.node for r in graph.on_cycles(edges).collect()} == {"А", "Б", "в"}  # a keyword as a name is in lower case
    two = _of_source(spark, "КЛАСС П1\nАТРИБУТЫ + x : Строка КОНЕЦ КЛАСС КЛАСС П2 АТРИБУТЫ + x : цел КОНЕЦ КЛАСС\nКЛАСС Дитя КОНЕЦ КЛАСС\nОБОБЩЕНИЕ Дитя -> П1\nОБОБЩЕНИЕ Дитя -> П2")
    up = extract.tdl_relations(two).join(extract.tdl_attributes(extract.tdl_classes(two)).withColumnRenamed("class", "target"), "target")
    assert up.groupBy("source", "name").agg(F.countDistinct("type_").alias("n")).where("n > 1").select("source", "name").first() == ("Дитя", "x")
    ghost = _of_source(spark, "КЛАСС А КОНЕЦ КЛАСС\nКЛАСС Б АТРИБУТЫ + что : Призрак КОНЕЦ КЛАСС\nАССОЦИАЦИЯ\n  А 1\n  --\n  Призрак *\n  ИМЯ \"связь\"\nОБОБЩЕНИЕ Б -> Нет")
    known = extract.tdl_classes(ghost).select("class")
    ends = extract.tdl_associations(ghost).select(F.explode(F.array("class1", "class2")).alias("class")).unionByName(extract.tdl_relations(ghost).select(F.col("target").alias("class")))
    types = extract.tdl_attributes(extract.tdl_classes(ghost)).select(F.col("type_").alias("class"))
    assert {r["class"] for r in ends.unionByName(types).join(known, "class", "left_anti").collect()} == {"Призрак", "Нет"}


def test_numbers_of_any_size_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    m = lambda t: tuple(one(fn.multiplicity(F.lit(t))))
    assert m("0..3000000000") == (0, 3000000000) and m("1 .. 3") == (1, 3) and m("*") == (0, None) and m("2..*") == (2, None) and m("1..x") == (None, None) and m("1..99999999999999999999") == (None, None)
    assert one(fn.multiplicities_text(fn.multiplicities(F.lit("1..3, 5, 7..*")))) == "1..3, 5, 7..*"
    c = lambda v, t: one(fn.coerced(F.lit(v), F.lit(t)))
    assert c("3000000000", "int") == "3000000000" and c("1d", "double") is None and c(" 1e3 ", "double") == "1000.0" and c("1.5", "int") is None and c("9" * 50, "Integer") == "9" * 50
    text = fn.parameter_text(F.lit("out"), F.lit("x"), F.lit("int"), F.lit("5"))
    assert one(text) == "out x : int  = 5" and one(fn.parameter_text(F.lit("in"), F.lit("x"), F.lit(None), F.lit(""))) == "x  = "
    assert one(fn.operation_text(F.lit("+"), F.lit("f"), F.array(text), F.lit(None), F.lit(True), F.lit(False), F.lit("guarded"))) == "+ f(out x : int  = 5) {isQuery, guarded}"
    assert one(fn.class_header(F.lit("utility"), F.lit("A"), F.lit(True), F.lit("0..4"))) == "«utility» A {abstract} 0..4"


def test_prompts(spark):
    t = spark.createDataFrame([(1, 1, "A", " Big\\n\t", "x")], "ontology_id long, seq long, name string, label string, description string")
    f = spark.createDataFrame([(1, 2, "F", "Does", "A", "")], "ontology_id long, seq long, name string, label string, output_term string, output_label string")
    a = spark.createDataFrame([(1, "F", 1, "A", "In")], "ontology_id long, function string, pos long, term string, label string")
    assert tuple(suggestions.prompts(t, f, a).first()) == (1, "'a', 'big', 'x'", "'f', 'does', ('a': 'in') -> 'a': ''")
    assert suggestions.prompts(t, f.limit(0), a).first().functions == ""


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "project_id long, name string, t string, content string").select("project_id", "name", F.to_timestamp("t").alias("ts"), "content")
    batches = [rows((1, "a", "2024-01-01", "one"), (2, "b", "2024-01-01", "b1")), rows((1, "a", "2024-01-02", "two"), (3, "c", "2024-01-02", "c1")), rows((1, "a", "2024-01-01 12:00:00", "late"), (2, "b", "2024-01-03", "b2")), rows((1, "a", "2024-01-04", "four"))]
    held = lambda: sorted((r.project_id, r.name, r.content) for r in edits.stored_files(spark, path).collect())
    for number, batch in enumerate(batches):
        edits.write_upserts(batch, number, path, buckets=4)
        once = held()
        edits.write_upserts(batch, number, path, buckets=4)
        assert held() == once
    assert once == [(1, "a", "four"), (2, "b", "b2"), (3, "c", "c1")]
    edits.write_upserts(batches[0].limit(0), 4, path, buckets=4)
    assert held() == once
    assert all(len(list(bucket.glob("batch=*"))) <= 2 for bucket in (tmp_path / "store").glob("bucket=*"))


def test_redefined_names_are_looked_for_in_all_ancestors(spark):
    up = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "b"), ("d", "x"), ("d", "c")], "specific string, general string")
    rows = [("a", 1, "top", None), ("b", 2, "mid", None), ("c", 3, "own", "top"), ("c", 4, "o2", "own"), ("d", 5, "p", "mid"), ("d", 6, "q", "gone"), ("x", 7, "r", "gone"), ("a", 8, "s", "top"), ("b", 9, "t", "mid")]
    attributes = spark.createDataFrame(rows, "class string, seq int, name string, redefines string")
    got = {(r["class"], r.redefines) for r in classmodel.redefines_unknown(attributes, up).collect()}
    # x has no parents; a and b are on a cycle, so each is its own ancestor.
    assert got == {("c", "own"), ("d", "gone")}


def test_drawings(spark):
    good = "<svg xmlns='http://www.w3.org/2000/svg'><path data-type='class' data-id='1' data-name='A&#60;B'/><g data-id=\"2\" data-type=\"class\"/>"
    link = '<g data-type="{}" data-src="A&lt;B" data-tgt="{}" {}/>'
    docs = [
        ("cut", good), ("none", "<svg><!-- <g data-type='class' data-id='x'/> --><g data-type='dependency' data-src='q'/></svg>"), ("fine", good + link.format("dependency", "2", "") + "</svg>"),
        ("warned", good + "<g data-type='realization' data-src='2'/></svg>"), ("noid", good + "<g data-type='class' data-name='C'/>" + "<g data-type='realization' data-src='2'/></svg>"),
        ("ghost", good + link.format("generalization", "ghost", "") + "<line data-type='association' data-end1-class='who' data-end2-class='2'/></svg>"),
        ("range", good + link.format("association", "2", "data-tgt-multiplicity='5..3'") + link.format("association", "2", "data-src-multiplicity='1..*'") + "</svg>"),
    ]
    d = spark.createDataFrame(docs, "doc string, svg string")
    got = sorted((r.doc, r.level, r.rule, r.subject or "") for r in extract.svg_findings(d).collect())
    assert got == [
        ("cut", "error", "not well formed", ""), ("ghost", "error", "unknown source", "who"), ("ghost", "error", "unknown target", "ghost"), ("noid", "error", "class without id", "C"),
        ("noid", "warning", "without ends", ""), ("none", "error", "no classes", ""), ("range", "error", "bad multiplicity", "5..3"), ("warned", "warning", "without ends", ""),
    ]
    status = {r.doc: (r.ok, r.n_errors, r.n_warnings) for r in extract.svg_status(d).collect()}
    assert status["fine"] == (True, 0, 0) and status["warned"] == (True, 0, 1) and status["noid"] == (False, 1, 0) and status["ghost"] == (False, 2, 0)


def test_results_of_builds(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    text = lambda rows, name: spark.createDataFrame(rows, f"id long, {name} string")
    said = lambda rows: spark.createDataFrame(rows, "id long, seq long, text string")
    got = workspace.build_results(ids, text([(1, "{}"), (2, "{}")], "json"), text([(1, "@")], "puml"), said([(2, 9, "late"), (2, 3, "first")]), said([(1, 5, "b"), (1, 2, "\x1b[1ma\x1b[0m"), (2, 1, "c")]))
    assert sorted(map(tuple, got.collect())) == [(1, True, "{}", "@", ["a", "b"], None), (2, False, None, None, [], "first"), (3, True, None, None, [], None)]


def test_results_put_exports_together_from_their_pieces_without_joins(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    said = spark.createDataFrame([], "id long, seq long, text string")
    piece = lambda rows: spark.createDataFrame(rows, "id long, section int, piece long, text string")
    json = piece([(1, 3, 0, "e"), (1, 1, 10, "c,d"), (1, 1, 2, "a,b"), (1, 2, 0, None)])
    puml = piece([(1, 9, 0, "}"), (1, 4, 1, "y"), (1, 0, 0, "{"), (1, 4, 0, "x\nx")])
    got = workspace.build_results(ids, json, puml, said, said)
    none = ",".join(f'"{t}":null' for t in ("version", "title", "author", "description", "type", "date"))
    assert sorted((r.id, r.json, r.puml) for r in got.collect()) == [(1, f'{{"meta":{{{none}}},"terms":[a,b,c,d],"functions":[],"hierarchy":[e],"figures":[]}}', "{\nx\nx\ny\n}"), (2, None, None)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_levels_of_imports_and_what_is_imported(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "gone")], "file_id string, target_id string")
    levels, n = resolution.import_levels(spark.createDataFrame([(x,) for x in "abcd"], "file_id string"), edges)
    assert n == 3 and sorted(map(tuple, levels.collect())) == [("a", 2, False), ("b", 1, True), ("c", 0, True), ("d", 0, False)]


def test_walks_end_in_cycles_and_are_none_for_names_that_no_class_has(spark, monkeypatch):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "d"), ("d", "e"), ("e", "f"), ("x", "f")], "specific string, general string")
    rows = [("a", 1, "p", "far"), ("a", 2, "q", "other"), ("a", 3, "q", "nowhere"), ("f", 4, "far", None), ("x", 5, "other", "far")]
    attributes = spark.createDataFrame(rows, "class string, seq int, name string, redefines string")
    for few in (0, 100):
        monkeypatch.setattr(classmodel, "FEW", few)
        assert sorted(r.seq for r in classmodel.redefines_unknown(attributes, up).collect()) == [2, 3]


def test_texts_are_written_by_all_tasks(spark):
    texts = spark.range(40).select(F.col("id").alias("file"), F.lit("x").alias("content")).coalesce(1)
    views = type("V", (), {"spark": spark})
    found = plans_texts._read_back(views, texts)
    assert found.count() == 40 and len({Path(f).name.split("-")[1] for f in found.inputFiles()}) > 1


def test_redefines_of_operations_and_generalizations_in_sets(spark):
    attributes = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "y", "f"), ("b", 3, "z", "x")], "class string, seq long, name string, redefines string")
    operations = spark.createDataFrame([("a", 4, "f", None), ("b", 5, "g", "f"), ("b", 6, "h", "x")], "class string, op long, name string, redefines string")
    sets = spark.createDataFrame([(1, [("b", "a")]), (2, []), (3, None)], "id int, generalizations array<struct<specific:string,general:string>>")
    up = classmodel.inheritance_edges(spark.createDataFrame([], "specific string, general string"), sets)
    assert [tuple(r) for r in up.collect()] == [("b", "a")]
    got = classmodel.redefines_unknown(classmodel.features(attributes, operations), up)
    assert sorted((r.element, r.seq) for r in got.collect()) == [("attribute", 2), ("operation", 6)]


def diagrams(spark, **rows):
    """Tables of a corpus of diagrams; those not given are empty."""
    kinds = {
        "classifiers": "class string, kind string, stereotype string",
        "generalizations": "specific string, general string",
        "generalization_sets": "generalizations array<struct<specific:string,general:string>>",
        "dependencies": "client string, supplier string",
        "realizations": "implementer string, interface string",
        "association_ends": "assoc_id long, end_no long, participant string, aggregation string, multiplicity string, role string, subsets string",
        "attributes": "class string, seq long, name string, type_ string, initial_value string, scope string, redefines string",
        "operations": "class string, op long, name string, return_type string, is_abstract boolean, is_query boolean, scope string, redefines string",
        "parameters": "op long, pos long, type_ string, direction string, default_value string",
        "template_parameters": "class string, pos long, type_ string, default_value string",
    }
    return {name: spark.createDataFrame(rows.get(name, []), "diagram string, " + kind) for name, kind in kinds.items()}


def test_diagrams_are_checked_apart(spark):
    def found(**rows):
        return sorted(tuple(r) for r in classmodel.diagram_violations(diagrams(spark, **rows)).drop("place").collect())

    assert found() == []
    both = [(d, c, "Class", None) for d in ("a/1", "a%2F1", None) for c in ("A", "B")]
    # Names of one diagram mean nothing in another; ids with slashes and null ids keep apart.
    assert found(classifiers=both, generalizations=[("a/1", "A", "B"), ("a%2F1", "B", "A")]) == []
    ring = found(classifiers=both, generalizations=[("a/1", "A", "B")], generalization_sets=[("a/1", [("B", "A")])])
    assert ring == [("a/1", 1, "cycle", "A", "inheritance cycle"), ("a/1", 1, "cycle", "B", "inheritance cycle")]
    only = [*both, ("d", "C", "Classifier", None), ("d", " ", "Class", None)]
    attributes = [("a/1", "A", 1, "x", "C", None, "instance", None), ("d", "C", 2, "x", "C", None, "instance", None), (None, "A", 3, "x", "int", "n/a", "instance", None)]
    operations = [("d", "C", 7, "f", "C", False, False, "instance", None), ("a/1", "A", 7, "f", "A", False, False, "instance", None)]
    got = found(classifiers=only, attributes=attributes, operations=operations, parameters=[("a/1", 7, 1, "C", "in", None)], template_parameters=[("a/1", "B", 1, "String", "Z")])
    assert got == [
        ("", 0, "value", "A", "n/a"), ("a/1", 5, "attribute type", "A", "C"), ("a/1", 6, "parameter type", "7", "unknown C"), ("a/1", 7, "template type", "B", "unknown Z"),
        ("d", 0, "name", " ", "blank or too long"), ("d", 6, "parameter type", "7", "not a class C"),
    ]
    ends = [("a/1", 1, 1, "A", "none", None, "r", None), ("a/1", 1, 2, "B", "none", None, None, "A"), ("d", 1, 1, "C", "none", "3..1", None, None), ("d", 1, 2, "A", "none", None, None, "r")]
    assert found(classifiers=only[:-1], association_ends=ends) == [("d", 0, "multiplicity", "1", "3..1"), ("d", 0, "subset", "1", "r"), ("d", 8, "end", "A", "association")]
    firsts = classmodel.first_by_step(classmodel.diagram_violations(diagrams(spark, classifiers=only[:-1], association_ends=ends)))
    assert sorted((r.diagram, r.rule_order, r.detail, r.raised) for r in firsts.collect()) == [("d", 0, "3..1", True), ("d", 8, "association", False)]


def test_first_broken_rule_of_an_association(spark):
    """One association breaks several rules: the one checked first is reported, whatever its name."""
    ends = [("a", 1, 1, "A", "composition", None, None, None), ("b", 2, 1, "A", "composition", None, None, None), ("b", 2, 2, "B", "composition", None, None, None)]
    known = [(d, c, "Class", None) for d in "ab" for c in "AB"]
    rows = classmodel.diagram_violations(diagrams(spark, classifiers=known, association_ends=ends))
    assert rows.where("rule = 'association'").count() == 4
    assert sorted((r.diagram, r.detail) for r in classmodel.first_by_step(rows).where("rule_order = 0").collect()) == [("a", "fewer than two ends"), ("b", "several compositions")]


def test_long_texts_are_joined_in_pieces(spark, monkeypatch):
    """No task of the first step sees a whole text; the text and its order are the same."""
    monkeypatch.setattr(exports, "PIECE", 10)
    rows = [(k, s, i * (1000 if i > 90 else 1) - 7, None if i == 50 else f"{k}{s}.{i}") for k in (1, 2) for s in (0, 3) for i in range(100)] + [(3, 0, 5, None), (4, 3, 1, "b"), (4, 3, 1, "a")]
    lines = spark.createDataFrame(rows, "k long, section int, seq long, line string").repartition(5)
    want = {k: "\n".join(f"{k}{s}.{i}" for s in (0, 3) for i in range(100) if i != 50) for k in (1, 2)} | {3: "", 4: "a\nb"}
    assert {r.k: r.t for r in exports.joined(lines, "k", "t").collect()} == want
    assert exports.pieces(lines, "k", "\n").where("k = 1").count() > 2
    kinds = spark.createDataFrame([(7, "figures", 1, "f"), (7, "terms", 2, "b"), (7, "terms", 1, "a"), (8, "meta", 0, "m")], "ontology_id long, kind string, seq long, json string")
    got = {r.ontology_id: r.json for r in exports.json_documents(kinds).collect()}
    assert got[8] == '{"meta":m,"terms":[],"functions":[],"hierarchy":[],"figures":[]}'
    assert got[7].endswith('},"terms":[a,b],"functions":[],"hierarchy":[],"figures":[f]}')


def shuffled_rows(spark, run):
    """The rows that the stages of a call write to shuffles."""
    gw, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def rows():
        stages = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = rows()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in rows().items() if k not in before)


def test_closure_makes_each_pair_about_once(spark):
    n = 257
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    out = []
    written = shuffled_rows(spark, lambda: out.append(graph.closure(edges).count()))
    assert out == [n * (n - 1) // 2] and written < 8 * out[0], written
    ring = spark.range(9).selectExpr("id as a", "(id + 1) % 9 as b").union(spark.createDataFrame([(20, 0), (5, 30), (7, 7)], "a long, b long"))
    want = {(a, b) for a in range(9) for b in range(9)} | {(20, b) for b in range(9)} | {(a, 30) for a in (*range(9), 20)}
    assert [tuple(r) for r in sorted(graph.closure(ring).collect())] == sorted(want)


def test_small_tables_of_long_texts_are_dealt_out(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.range(40).coalesce(1)
    drawings = one.selectExpr("id as doc", "'<svg><g data-type=\"class\" data-id=\"1\"/></svg>' as svg")
    assert extract.svg_elements(drawings).rdd.getNumPartitions() == n and extract.svg_findings(drawings).count() == 0
    sources = one.selectExpr("id as file", "concat('класс c', id, ' конец класс') as content")
    found = extract.tdl_statements(sources)
    assert found.rdd.getNumPartitions() == n and extract.tdl_classes(found).count() == 40


def test_attribute_blocks_are_read_once(spark):
    line = "a inheritance b, { color: '#1', title: 'color: x', color: '#2' }"
    lines = spark.createDataFrame([(1, 0, "hierarchy", line)], "file long, line int, section string, text string")
    found = extract.relationships(lines)
    assert [(r.color, r.title, r.direction) for r in found.collect()] == [("#2", "color: x", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan
    odd = spark.createDataFrame([(1, " \t\r\n# c\n\t# '\n a # x\n'#'\n\n{\n}\nb")], "file long, content string")
    assert [r.text for r in extract.logical_lines(odd).orderBy("line").collect()] == ["a", "'#'", "{}", "b"]


def test_statements_are_taken_as_they_are(spark):
    sources = spark.createDataFrame([(1, 'зависимость a -> b "use" агрегация a [1] -- b')], "file long, content string")
    found = extract.tdl_statements(sources)
    assert extract.tdl_relations(found).count() == extract.tdl_associations(found).count() == 1


def test_lines_are_sorted_by_native_functions(spark):
    rows = [(1, 0, 2, "b"), (1, 0, 1, "z"), (1, 0, 2, "a"), (1, 3, 0, None), (1, 4, 5, "last"), (2, 0, 1, None)]
    lines = spark.createDataFrame(rows, "k long, section int, seq long, line string")
    out = exports.joined(lines, "k", "text")
    assert {r.k: r.text for r in out.collect()} == {1: "z\na\nb\nlast", 2: ""}
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()


def test_statements_keep_all_but_comments_and_breaks(spark):
    text = "a: 'x # \"\n' \"#'\" # c ' d\nb: {k: 'v' # c }\n, l: \"#\"} # it's\nc 'open # c\n#\n\nd (x\n) # \"\n' # e"
    got = extract.logical_lines(spark.createDataFrame([("f", text)], "file string, content string")).orderBy("line").collect()
    assert [r.text for r in got] == ["a: 'x # \"\n' \"#'\"", "b: {k: 'v' , l: \"#\"}", "c 'open # c\n#\n\nd (x\n) # \"\n'"]


def test_long_sources_come_in_pieces(spark, monkeypatch):
    """A header holds for the pieces behind it, and no row of the fixture is a whole source."""
    rows = [
        ("f", 1, 0, "title: 'types:'\n  types:  # 'x'\na: 'A', ''"), ("f", 1, 1, "b: 'B', 'hierarchy:\nfunctions:'"), ("f", 1, 2, "# hierarchy:\n\n"), ("f", 3, 0, "c: 'C', ''\nfigure 'F' : \n a\nfigure G:"),
        ("f", 3, 7, "b"), ("f", 5, 0, "hierarchy:"), ("f", 5, 1, "a is b, {color: 'x', color: 'y'\n}"), ("g", 1, 0, "types"), ("g", 1, 1, "title: 'T'"),
    ]
    found = extract.sections(spark.createDataFrame(rows, "file string, block int, piece long, content string").repartition(4)).cache()
    got = [(r.file, r.section, r.text) for r in found.orderBy("file", "block", "piece", "line").collect()]
    assert got == [
        ("f", "meta", "title: 'types:'"), ("f", "types", "a: 'A', ''"), ("f", "types", "b: 'B', 'hierarchy:\nfunctions:'"), ("f", "types", "c: 'C', ''"), ("f", "figure 'F'", "a"), ("f", "figure G", "b"),
        ("f", "hierarchy", "a is b, {color: 'x', color: 'y'}"), ("g", "meta", "types"), ("g", "meta", "title: 'T'"),
    ]
    assert sorted((r.name, r.block) for r in extract.terms(found).collect()) == [("a", 1), ("b", 1), ("c", 3)]
    assert [r.color for r in extract.relationships(found).collect()] == ["y"] and [r.value for r in extract.attributes(found).collect()] == ["y"]
    monkeypatch.setattr(exports, "PIECE", 500)
    v = Views(spark, "/root/testdata/sf0.001")
    assert plans_texts._sources(v, (5, "hierarchy", plans_texts._named(v))).count() > 500
    assert plans.QUERIES["section_of_line"](spark, "/root/testdata/sf0.001").where("section = 'functions'").count() == v("functions").count()


def test_whole_texts_are_made_in_their_aggregation(spark):
    """No column holds the pieces of a whole document beside it."""
    kinds = spark.createDataFrame([(k, "terms", i, f"t{i}") for k in range(40) for i in range(30)], "ontology_id long, kind string, seq long, json string")
    lines = spark.createDataFrame([(k, 1, i, f"t{i}") for k in range(40) for i in range(30)], "ontology_id long, section int, seq long, line string")
    for made, want in ((exports.json_documents(kinds), '"terms":[' + ",".join(f"t{i}" for i in range(30)) + "]"), (exports.joined(lines, "ontology_id", "text"), "\n".join(f"t{i}" for i in range(30)))):
        assert [want in r[1] for r in made.collect()] == [True] * 40
        assert made._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_files_are_written_without_a_folder_or_checksum_for_each(spark):
    texts = spark.createDataFrame([(7, "7\n8"), (8, ""), (9, None), (None, "abc"), (10, "a\n")], "file long, content string")
    found = plans_texts._read_back(type("V", (), {"spark": spark}), texts)
    assert sorted(map(str, found.select("file", "n").collect())) == sorted(f"Row(file={f}, n={n})" for f, n in ((7, 3), (8, 0), (9, 0), (None, 3), (10, 1)))
    folders = {Path(f.removeprefix("file:")).parent for f in found.inputFiles()}
    assert len(folders) == 1 and not [f for f in folders.pop().iterdir() if f.is_dir() or f.name.startswith(".part-")]
