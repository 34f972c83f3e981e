"""Canonical names and markers by hand."""

from pyspark.sql import functions as F

from loomgraph.functions import markers
from loomgraph.operators import canonical


def registry(spark):
    return canonical.Registry(
        spark.createDataFrame([("Vue.js", "web"), ("vuejs", "z"), ("Docker", "ops"), ("K8s", None), (None, "x"), ("C", "lang"), ("C++", "lang"), ("···", "odd")], "canonical string, category string"),
        spark.createDataFrame([("鸟瞰", "Docker", "a"), ("鸟瞰", "C", "b"), ("docker", "K8s", "alias"), (None, "C", ""), ("Docker", "C", "shadow")], "name string, canonical string, category string"),
        spark.createDataFrame([("K8s", "Kubernetes"), ("Kubernetes", "Kube"), (None, "x")], "id string, target string"),
        spark.createDataFrame([("C / C++", ["C", "C++"]), ("c-c", ["K8s", "C"]), ("none", [])], "name string, targets array<string>"),
    )


def test_layers(spark):
    names = spark.createDataFrame([(n,) for n in ["Vue JS", "Vue.js", "docker", "DOCKER", "Docker", "鸟瞰", "k8S", "new one", "···", " ", None, "new one"]], "name string")
    found = {r.name: (r.canonical, r.category, r.layer) for r in canonical.resolve(names, registry(spark)).collect()}
    assert found == {
        "Vue JS": ("Vue.js", "web", "l1"),
        "Vue.js": ("Vue.js", "web", "l2"),
        "docker": ("Kube", "alias", "l2"),
        "DOCKER": ("Docker", "ops", "l1"),
        "Docker": ("C", "shadow", "l2"),
        "鸟瞰": ("C", "b", "l2"),
        "k8S": ("Kube", "", "l1"),
        "new one": ("new one", "", "keep"),
        "···": ("···", "odd", "l2"),
        " ": (" ", "", "keep"),
    }


def test_order_and_repeats_are_kept_once(spark):
    rows = [("d", "s", 3, "C/C++"), ("d", "s", 1, "C++"), ("d", "s", 2, "k8s"), ("d", "s", 5, "cc"), ("d", "s", 6, None), ("d", "t", 1, "Vue JS"), ("d", "t", 0, "vue.js"), (None, "t", 0, "x")]
    frame = spark.createDataFrame(rows, "doc string, skill string, place int, name string")
    after = canonical.normalised(frame, registry(spark), ["doc", "skill"])
    # `C/C++` and `c-c` fold alike: of both expansions the smaller counts
    assert sorted((tuple(r) for r in after.collect()), key=str) == [("d", "s", "C", 2), ("d", "s", "C++", 0), ("d", "s", "Kube", 1), ("d", "t", "Vue.js", 0), (None, "t", "x", 0)]
    stats = {r.skill: tuple(r)[1:] for r in canonical.backfill_stats(frame, after, "skill").collect()}
    assert stats == {"s": (4, 3, 1, 3), "t": (3, 2, 1, 2)}
    assert canonical.normalised(frame.limit(0), registry(spark), ["doc", "skill"]).collect() == []


def test_markers_and_years(spark):
    rows = [(["熟悉Python，3-5年经验", "精通 Spark"], "F-1"), (["了解", "x" * 299 + "精通"], "S-1"), (["a"] * 6 + ["精通20年"], "F-2"), ([], "S-2"), (None, "F-3"), (["20 年以上，3年"], None)]
    df = spark.createDataFrame(rows, "s array<string>, code string")
    text = df.select("code", markers.read(F.col("s")).alias("t"))
    found = text.select(markers.markers(F.col("t")).alias("m"), markers.year_hints(F.col("t")).alias("h"), markers.most_years(markers.year_hints(F.col("t"))).alias("y"), markers.gated(F.col("code"), markers.markers(F.col("t"))).alias("g"), markers.gated(F.col("code"), markers.markers(F.col("t")), True).alias("a")).collect()
    assert [tuple(r) for r in found[:4]] == [(["熟悉", "精通"], ["3-5年", "5年"], 5, False, False), (["了解"], [], None, False, False), ([], [], None, True, True), ([], [], None, False, True)]
    assert (found[5].h, found[5].y) == (["20 年以上", "3年"], 15)


def test_points_are_cleaned(spark):
    from loomgraph.functions import points

    rows = [["Ｐｙｔｈｏｎ", " python、", "PYTHON"], ["西门子PLC", "三菱 PLC", "PLC", "西门子"], ["示波器", "C", "x" * 31, "x" * 30, "瑞昱芯片", "平台", None, "；·  "], None, [], ["Spring   Boot", "spring boot", "Spring"]]
    df = spark.createDataFrame([(r,) for r in rows], "p array<string>")
    assert [r.c for r in df.select(points.cleaned(F.col("p")).alias("c")).collect()] == [["Python"], ["PLC", "三菱 PLC"], ["x" * 30], [], [], ["Spring Boot", "Spring"]]
