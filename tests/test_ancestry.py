import random

from driftline.operators.ancestry import ancestors, commits_behind_main

EDGE = "repo int, child long, parent long, parent_no int"
COMMIT = "repo int, commit long, ts timestamp"


def closure(parents, start):
    seen, todo = set(), [start]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents.get(c, [])
    return seen


def random_graph(rng, n):
    """Commit -> parents, with merges of up to three parents."""
    return {
        c: rng.sample(range(max(0, c - 6), c), min(c, rng.choice([1, 1, 1, 2, 3])))
        for c in range(1, n)
    }


def frames(spark, graphs):
    import datetime as dt

    edges = [
        (r, c, p, i) for r, g in graphs.items() for c, ps in g.items() for i, p in enumerate(ps, 1)
    ]
    day = dt.datetime(2024, 1, 1)
    commits = [
        (r, c, day + dt.timedelta(minutes=c)) for r, g in graphs.items() for c in {0, *g}
    ]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(commits, COMMIT)


def test_ancestors_of_random_graphs(spark):
    rng = random.Random(3)
    graphs = {r: random_graph(rng, 60) for r in range(4)}
    edges, _ = frames(spark, graphs)
    seeds = spark.createDataFrame(
        [(r, "x", rng.randrange(20, 60)) for r in graphs] + [(0, "y", 5)],
        "repo int, label string, commit long",
    )
    got = {(r.repo, r.label, r.commit) for r in ancestors(edges, seeds).collect()}
    want = {(s.repo, s.label, c) for s in seeds.collect() for c in closure(graphs[s.repo], s.commit)}
    assert got == want


def test_deep_history(spark):
    n = 3000  # far deeper than a recursive query would go
    edges, _ = frames(spark, {0: {c: [c - 1] for c in range(1, n)}})
    seeds = spark.createDataFrame([(0, "tip", n - 1)], "repo int, label string, commit long")
    assert ancestors(edges, seeds).count() == n


def behind(parents, branch, main):
    on_main, on_branch = closure(parents, main), closure(parents, branch)
    common = on_main & on_branch
    if not common:
        return 0
    best = [c for c in common if not any(c in closure(parents, o) for o in common if o != c)]
    return len(on_main - closure(parents, max(best)))


def test_behind_main(spark):
    rng = random.Random(11)
    graphs = {r: random_graph(rng, 40) for r in range(8)}
    graphs[100] = {1: [0], 2: [0], 3: [1, 2], 4: [2, 1], 5: [3], 6: [4]}  # criss-cross
    edges, commits = frames(spark, graphs)
    tips = {r: (rng.randrange(20, 40), rng.randrange(20, 40)) for r in range(8)}
    tips[100] = (5, 6)
    refs = [(r, "work", b) for r, (b, _) in tips.items()]
    refs += [(r, "master" if r % 2 else "main", m) for r, (_, m) in tips.items()]
    heads = [(r, "work") for r in tips] + [(200, "main"), (201, "solo"), (202, "work")]
    # 200 is on main, 201 has no main, 202 shares no history with it
    refs += [(200, "main", 1), (201, "solo", 1), (202, "work", 1), (202, "main", 2)]
    got = commits_behind_main(
        spark.createDataFrame(heads, "repo int, branch_name string"),
        spark.createDataFrame(refs, "repo int, name string, tip long"),
        edges,
        commits,
    )
    want = {r: behind(graphs[r], b, m) for r, (b, m) in tips.items()}
    want |= {200: 0, 201: 0, 202: 0}
    assert {r.repo: r.behind_main_by_commits for r in got.collect()} == want
    assert want[100] == 3  # 6, 4 and the other base's side
