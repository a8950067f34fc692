import random

from docmill.operators.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_random_graphs_chain_and_star(spark):
    rng = random.Random(1)
    cases = [[(rng.randrange(60), rng.randrange(60)) for _ in range(40)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)], [(5, 5)]]
    for edges in cases:
        rng.shuffle(edges)
        df = spark.createDataFrame(edges, "a int, b int")
        assert {r.node: r.root for r in components(df, "a", "b").collect()} == brute(edges)


def test_empty_and_null(spark):
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert {r.node: r.root for r in components(df, "a", "b").collect()} == {2: 2, 3: 2}
