"""The paths that only large tables take, with small tasks: salts, many classes, draws in blocks."""

import json
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemend import session
from tablemend.catalog import files
from tablemend.operators import correlate, lookup, near_duplicates, neighbours, ordering, resample
from tablemend.plans import training
from tablemend.sources import charset


def test_hot_values_are_spread(spark):
    df = spark.range(500).selectExpr("id", "case when id < 200 then 'hot' when id < 350 then null else concat('v', id % 40) end as v")
    table = lookup.value_counts(df, "v")
    salts = {r["__hot"]: r["__salts"] for r in lookup.salt_table(table, 50).collect()}
    assert salts == {"hot": 4}
    plain = sorted(lookup.attach_by_value(df, "v", table).collect(), key=str)
    assert sorted(lookup.attach_by_value(df, "v", table, table, task_rows=50).collect(), key=str) == plain
    left = df.filter("v is not null")
    keyed = table.withColumnRenamed("value", "v")
    for how in ("inner", "left"):
        spread = lookup.join_spread(left, keyed, ["v"], how, task_rows=50)
        assert sorted(spread.select("id", "v", "n").collect()) == sorted(left.join(keyed, "v", how).select("id", "v", "n").collect())


@pytest.mark.parametrize("classes", [2_000, 20_000])
def test_many_classes_are_stratified(spark, classes):
    df = spark.range(5 * classes).selectExpr("id", f"id % {classes} as y")
    parts = resample.stratified_split(df, "id", "y").groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert parts.filter("t <> 1 or n <> 5").count() == 0 and parts.count() == classes


def test_two_rows_make_a_class(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_DRAWS", 16)
    df = spark.range(120).selectExpr("id", "cast(id < 2 as double) as label", "array(cast(id as double), 1D) as vec")
    made = resample.smote(df, "id")
    assert made.count() == 116 and made.filter("vec[0] < 0 or vec[0] > 1").count() == 0


@pytest.mark.parametrize("classes", [1_001, 20_000])
def test_many_classes_are_balanced(spark, classes):
    df = spark.range(3 * classes).selectExpr("id", f"id % {classes} as label", "array(cast(id * 7 % 11 as double), cast(id % 13 as double)) as vec")
    df = df.filter(f"label < 5 or id < {2 * classes}")
    made = resample.smote(df, "id").groupBy("label").agg(F.count("*").alias("n"))
    assert made.filter("n <> 1 or label < 5").count() == 0 and made.count() == classes - 5


def test_balance_removes_links_of_the_union(spark):
    """SMOTE fills the classes, then both rows of every pair of mutual nearest rows under two labels go, synthetic ones too."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 5 == 0), [float(v) for v in rng.normal(i % 5 == 0, 1.0, 2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label double, vec array<double>")
    made = resample.smote(df, "id").collect()
    union = [(label, vec, i, None) for i, label, vec in rows] + [(r["label"], r["vec"], r["source"], r["draw"]) for r in made]
    assert sum(u[0] == 1 for u in union) == 120
    x, y = np.array([u[1] for u in union]), np.array([u[0] for u in union])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1)
    linked = {i for i in range(len(union)) if near[near[i]] == i and y[i] != y[near[i]]}
    left = sorted((u[0], u[2], u[3] or 0) for i, u in enumerate(union) if i not in linked)
    kept = resample.balance(df, "id").collect()
    assert linked and sorted((r["label"], r["source"], r["draw"]) for r in kept) == left
    data = training.prepare(spark.createDataFrame([(i, v[0], v[1], y) for i, y, v in rows], "id long, a double, b double, y double"), "y", "id")
    assert data.balanced and data.train_rows < 2 * data.train.filter("label = 0").count()


def test_many_classes_train_balanced(spark):
    """Over 1,000 classes training is balanced like any other."""
    df = spark.range(4400).selectExpr("id", "if(id < 4004, id % 1001, 7) as y", "(id % 1001) * 1D as x")
    data = training.prepare(df, "y", "id", task="classification")
    assert data.balanced and data.classes == 1001
    sizes = data.fitted_on.groupBy("label").count()
    assert sizes.agg({"count": "min"}).first()[0] > 3


def test_text_targets_train(spark):
    df = spark.range(200).selectExpr("id", "(id % 2) * 10D + id % 3 as x", "element_at(array('no', 'yes'), cast(id % 2 + 1 as int)) as y")
    done = training.train_and_compare(df, "y", "id", training.TREE, options={training.TREE: {"maxDepth": 3}})
    assert done.best.scores["accuracy"] > 0.95


def test_postings_stay_narrow(spark):
    """A posting's size does not grow with the number of leading terms of its row, and near copies of long rows are found."""
    rare = [" ".join(f"r{j}x{i}" for i in range(400)) for j in range(5)]
    df = spark.createDataFrame([(2 * j + k, f"{r} w{k}") for j, r in enumerate(rare) for k in range(2)], "id long, text string")
    vectors = near_duplicates._vectors(near_duplicates._folded(df, "id", ["text"]), cosine=0.97)
    kinds = "term long, id long, mark long, nth int, left double, before binary, groups binary"
    postings = vectors.select("id", "mark", "terms", "w").mapInArrow(near_duplicates._postings(0.97), kinds)
    widest = postings.agg(F.max("nth").alias("nth"), F.max(F.length("before") + F.length("groups")).alias("bytes")).first()
    assert widest["nth"] > near_duplicates.EARLIER and widest["bytes"] <= 8 * near_duplicates.EARLIER + 2 * near_duplicates.GROUPS
    found = {r["id"]: r["near_id"] for r in near_duplicates.near_duplicate_rows(df, "id", ["text"]).collect()}
    assert found == {i: i ^ 1 for i in range(10)}


def test_pairs_are_multiplied_once(spark, monkeypatch):
    """Long rows that share hundreds of leading terms are one pair, multiplied once; all near copies are found, and what was
    written on the way is gone."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for i in range(24):
        own = rng.choice(words, 900)
        rows.append((2 * i, " ".join([f"only{i}"] * 2 + list(own))))
        # every third one has a near copy
        rows.append((2 * i + 1, " ".join([f"copy{i}"] + list(own if i % 3 == 0 else rng.choice(words, 900)))))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    cosine, pairs = 0.6, []
    vectors = near_duplicates._vectors(near_duplicates._folded(df, "id", ["text"]), cosine=cosine)
    real = near_duplicates._multiplied
    monkeypatch.setattr(near_duplicates, "BLOCK_TERMS", 4_000)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 10)
    monkeypatch.setattr(near_duplicates, "_multiplied", lambda p, v, c: (pairs.append(p), real(p, v, c))[1])
    with session.scratch(spark):
        found = {r["id"]: (r["near_id"], r["cosine"]) for r in near_duplicates._linked(session.stored(vectors), cosine).collect()}
        asked = [(r["id"], r["near_id"]) for r in pairs[0].collect()]
        kept = [r.asDict() for r in vectors.collect()]
        paths = list(session._WRITTEN.get()[-1])
    assert asked and len(asked) == len({frozenset(p) for p in asked})
    cells = {r["id"]: dict(zip(r["terms"], r["w"])) for r in kept}
    like = {a: {b: sum(w * cells[b].get(t, 0.0) for t, w in cells[a].items()) for b in cells if b != a} for a in cells}
    want = {a: (min(b for b, c in near.items() if c >= cosine), max(near.values())) for a, near in like.items() if max(near.values()) >= cosine}
    assert len(want) >= 16 and found == {a: (b, pytest.approx(c)) for a, (b, c) in want.items()}
    assert len(paths) > 2 and not any(Path(p.removeprefix("file:")).exists() for p in paths)


def test_blocks_where_cells_rule_out_little(spark, monkeypatch):
    """Where nearly all cells are needed, a query is sent once to each block of rows, not to each cell."""
    monkeypatch.setattr(neighbours, "CELLS", 2_000)
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (700, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    sent = []
    search = neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda asked, *rest: sent.append(asked.count()) or search(asked, *rest))
    found = neighbours.nearest(df, df, 3, block=200)
    got = {}
    for r in neighbours.attach_neighbours(df, found, "id", False, 3).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert all([n for _, n in sorted(got[i])] == np.argsort(d[i], kind="stable")[:3].tolist() for i in range(700))
    assert sent == [700, 700]


def test_distances_to_pivots_are_held_in_blocks(spark, monkeypatch):
    """A batch of many rows against many pivots holds a bounded block of distances, and rules out only cells out of reach."""
    tasks = []
    made = F.struct(F.lit(0).alias("cell"), F.lit(0.0).alias("reach"))
    monkeypatch.setattr(neighbours.F, "pandas_udf", lambda kind: lambda task: tasks.append(task) or (lambda *cells: made))
    rng = np.random.default_rng(5)
    centres, x = rng.normal(0, 1, (1_000, 3)), rng.normal(0, 1, (6_000, 3))
    rows = spark.createDataFrame([], "vec array<double>, q1 long, q2 long")
    neighbours._assign(rows, centres)
    bounds = {c: (1, 0.0, 0.1) for c in range(999)}
    neighbours._route(rows, centres, bounds)
    vec = pd.Series(list(x))
    tracemalloc.start()
    placed = tasks[0](vec)
    limit = pd.Series(np.where(np.arange(6_000) % 50, 0.05, np.nan))
    cells = tasks[1](vec, placed["cell"], limit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # all distances at once are 48 MB, several times
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    assert (placed["cell"] == d.argmin(1)).all() and np.allclose(placed["reach"], d.min(1))
    for i in range(0, 6_000, 25):
        sure = set(np.flatnonzero(d[i, :999] <= 0.0) if i % 50 else range(999)) - {placed["cell"][i]}
        assert sure <= set(cells[i]) <= (set(np.flatnonzero(d[i] <= 0.16)) if i % 50 else set(range(999)))


def test_bound_of_the_nearest_cells():
    """At least k cells of each row are within the bound, and few more."""
    rough = np.random.default_rng(6).normal(0, 1, (50, 3_001))
    within = (rough <= neighbours._edge(rough, 6)[:, None]).sum(1)
    assert within.min() >= 6 and within.max() <= 6 * neighbours.FOLD


@pytest.mark.parametrize("limit", [np.inf, 0.05])
def test_leaves_find_the_same_rows(monkeypatch, limit):
    """Leaves of nearby rows find what all rows with all do, ties and limits included, on few pairs."""
    rng = np.random.default_rng(3)
    for make in (lambda n: rng.random((n, 3)), lambda n: rng.integers(0, 9, (n, 3)) / 9.0, lambda n: np.c_[np.arange(n) / n, np.zeros(n)]):
        x, b = make(1_500), make(4_000)
        want = neighbours._top(x, b, 5)
        want = [c[want[2] <= limit] for c in want]
        pairs, top = [], neighbours._top
        monkeypatch.setattr(neighbours, "_top", lambda q, c, k: (pairs.append(len(q) * len(c)), top(q, c, k))[1])
        found = neighbours._within(x, b, 5, np.full(len(x), limit))
        monkeypatch.setattr(neighbours, "_top", top)
        order, other = np.lexsort((want[1], want[0])), np.lexsort((found[1], found[0]))
        assert all(np.array_equal(u[order], v[other]) for u, v in zip(want, found, strict=True))
        assert sum(pairs) < len(x) * len(b) / 2
    x[3] = np.nan  # as without leaves
    assert all(np.array_equal(u, v) for u, v in zip(neighbours._within(x, b, 5, np.full(len(x), np.inf)), neighbours._top(x, b, 5), strict=True))


def test_vectors_are_no_payload(spark, monkeypatch):
    """SMOTE sends marks of neighbours through the search, and each synthetic row lies between its source and its partner."""
    payloads, real = [], resample.nearest
    monkeypatch.setattr(resample, "nearest", lambda q, b, k, payload=None, **o: (payloads.append(b.select(*payload).dtypes), real(q, b, k, payload, **o))[1])
    rng = np.random.default_rng(4)
    at = {i: [float(v) for v in rng.normal(0, 1, 2)] for i in range(60)}
    df = spark.createDataFrame([(i, v, 0 if i < 45 else 1) for i, v in at.items()], "id long, vec array<double>, label int")
    made = resample.smote(df, "id").collect()
    assert len(made) == 30 and payloads and all(kind == "bigint" for _, kind in payloads[0])
    for r in made:
        a, b, v = (np.array(c) for c in (at[r["source"]], at[r["partner"]], r["vec"]))
        step = ((v - a) @ (b - a)) / ((b - a) @ (b - a))
        assert 0 <= step < 1 and np.allclose(v, a + step * (b - a))


def test_cuts_are_passed_by_halving(spark):
    """As many cuts as are not beyond the key, whatever their number."""
    for n in (1, 2, 7, 8, 33):
        cuts = F.array(*[F.struct(F.lit(str(c // 10)).alias("a"), F.lit(c).alias("b")) for c in range(10, 10 + 2 * n, 2)])
        keys = spark.range(10, 90).select("id", F.struct((F.col("id") / 10).cast("int").cast("string").alias("a"), F.col("id").cast("int").alias("b")).alias("__key"))
        passed = {r["id"]: r["at"] for r in keys.select("id", ordering._passed(cuts, n).alias("at")).collect()}
        want = {i: sum((str(c // 10), c) <= (str(i // 10), i) for c in range(10, 10 + 2 * n, 2)) for i in range(10, 90)}
        assert passed == want


def test_rank_sums_need_one_join_of_the_rows(spark, monkeypatch):
    """Rows meet the target's ranks only, once with holes and once without; ties and holes count as they should."""
    joins = []
    attach = correlate.attach_by_value
    monkeypatch.setattr(correlate, "attach_by_value", lambda *a: joins.append(1) or attach(*a))
    rng = np.random.default_rng(8)
    y = rng.normal(0, 1, 900).round(1)
    cells = {"a": (y + rng.normal(0, 1, 900)).round(1), "b": rng.integers(0, 4, 900) * 1.0, "c": np.where(rng.random(900) < 0.3, np.nan, -y)}
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*cells.values(), y)]
    found = {r["column"]: r["r"] for r in correlate.all_rank_correlations(spark.createDataFrame(rows, "a double, b double, c double, y double"), "y").collect()}
    table = pd.DataFrame(cells)
    for c in cells:
        there = table[c].notna()
        want = abs(np.corrcoef(table[c][there].rank(), pd.Series(y)[there].rank())[0, 1])
        assert abs(found[c] - want) < 1e-9
    assert len(joins) == 2


def test_charset_files_stay_small(spark, monkeypatch):
    """Larger tables are written as more files, not as larger ones, and all rows come back."""
    monkeypatch.setattr(files, "FILE_BYTES", 3_000)
    places = []
    scan = files.csv.scan_csv_folder
    monkeypatch.setattr(files.csv, "scan_csv_folder", lambda spark, path: places.append(path) or scan(spark, path))
    folder = "/root/testdata/sf0.001"
    back = files.charset_folder_scan(spark, folder).count()
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    assert back == documents.count()
    assert spark.read.text(places[0]).select("_metadata.file_path").distinct().count() > max(12, size / 9_000)


def test_batches_of_long_lines_are_short(tmp_path, monkeypatch):
    monkeypatch.setattr(charset, "CHARS", 50)
    (tmp_path / "a.csv").write_text("0123456789\n" * 23)
    reader = charset.CharsetReader({"paths": json.dumps([str(tmp_path / "a.csv")])})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(len(b) for b in batches) == 5
    assert [n for b in batches for n in b.column("number").to_pylist()] == list(range(23))
