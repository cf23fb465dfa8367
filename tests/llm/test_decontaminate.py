import duckdb

from modelgraph.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(d.OP4_SQL).fetchall()
    got = d.op4_template_contamination(spark, SF)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


ITEM = "A train leaves with Anna at 60 km per hour and after 3 hours it has gone how far from Anna in all"


def test_templates(spark):
    other = ITEM.replace("Anna", "Boris").replace("60", "75").replace("3 hours", "4 hours")
    mixed = ITEM.replace("with Anna", "with Boris").replace("from Anna", "from Carla")
    rows = [(1, "x y z. " + ITEM), (2, "well then " + other + ". end"), (3, mixed), (4, None), (5, ""), (6, "one two"), (None, ITEM), (7, "nothing to see here " * 3000), (8, ITEM.upper()), (1, "x y z. " + ITEM)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, ITEM, "c"), (10, ITEM, "c"), (11, None, "c"), (12, "too short", "c"), (None, ITEM, "c")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (8, 10)}
    assert got[1, 10].exact and not got[2, 10].exact
    assert got[2, 10].n_changed == 3
    assert {r.doc_id for r in d.contaminated(docs, bench, most_mb=0).collect()} == {1, 2, 8}
    assert d.contaminated(docs.limit(0), bench).count() == 0 == d.contaminated(docs, bench.limit(0)).count()


def pairs(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.contaminated(docs, bench).collect()}


BEN = "Ben has 5 apples. Ben gives 2 to Tim. How many apples does Ben have left?"


def test_names_that_begin_sentences(spark):
    other = BEN.replace("Ben", "Zoe").replace("Tim", "Max").replace("5", "9").replace("2", "4")
    owned = "Anna's box and Anne-Marie's bag hold 7 pens. Anna's sister takes away all the blue ones she can find"
    texts = [
        "Well. " + other,
        other.replace("does Zoe", "does Kim"),  # no single counterpart
        owned.replace("Anna", "Olga").replace("Anne-Marie", "Eva-Lotta").replace("7", "8"),
        "now " + BEN,
        "Mia has 5 pears. Mia sells 2 to Tim. How many coins does Mia have now?",
    ]
    got = pairs(spark, texts, [BEN, owned])
    assert set(got) == {(0, 0), (2, 1), (3, 0)}
    assert got[3, 0].exact and not got[0, 0].exact


def test_short_items(spark):
    items = ["What is the capital of France and who founded it?", "A dog of the house barks at the moon", "What is the capital of France?", "2 + 2 = 4", "in which year was the bridge built"]
    before = ["", "1) ", "(", "Question 5\n", "see this ", "End. "]
    texts = [b + i for i in items for b in before]
    got = pairs(spark, texts + ["Madrid is the capital of Spain?", "well 2 - 2 = 0 or 3 + 2 = 4", "What is the capital of Spain?"], items)
    for k, text in enumerate(texts):
        assert (k, k // len(before)) in got and got[k, k // len(before)].exact, text
    n = len(texts)
    assert {p for p in got if p[0] >= n} == {(n + 2, 2)}


def test_equal_numbers_and_single_changes(spark):
    fruit = "Tom has 5 apples and Ann has 5 pears in a large basket that stands behind the door of the old house"
    long = "the clerk sold 5 lamps on monday and later told Carla that a crate with the same goods would come back to the shop soon after that she went home and wrote to Carla about 5 chairs and a table that her uncle had built long ago"
    texts = [fruit.replace("5 a", "7 a").replace("5 p", "9 p"), long.replace("5 chairs", "6 chairs"), long.replace("Carla about", "Clara about"), fruit.replace("Ann", "Eve").replace("5 p", "6 p")]
    mixed = "then Anna met Boris at the gate before Anna took the train and Anna came home to see Boris again"
    texts.append(mixed.replace("before Anna", "before Carla").replace("and Anna", "and Doris"))
    got = pairs(spark, texts, [fruit, long, mixed])
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 0)}
    assert not any(r.exact for r in got.values())
