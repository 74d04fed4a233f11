from urna.operators import traversal

ROOTS = [("r1", "camera", "2001-05-13"), ("r2", "senato", "2001-05-13"), ("r3", "camera", "1996-04-21")]
PAGES = [("r1", None), ("a", None), ("b", None), ("c1", "ROMA"), ("c2", "Milano"), ("r2", None), ("d", None), ("c3", "BARI"), ("lone", "NAPOLI"), ("e", None)]
EDGES = [
    ("r1", "a"), ("r1", "b"), ("a", "c1"), ("b", "c2"), ("b", "c1"), ("b", "b"), ("c2", "r1"), ("c1", "beyond"),
    ("r2", "d"), ("d", "c3"), ("d", "gone1"), ("gone1", "c2"), ("r2", "e"), ("e", "gone2"), ("e", "gone3"), ("d", None), (None, "x"),
]


def frames(spark, pages=PAGES, edges=EDGES, roots=ROOTS):
    return (
        spark.createDataFrame(pages, "url string, municipality string"),
        spark.createDataFrame(edges, "parent_url string, child_url string"),
        spark.createDataFrame(roots, "url string, category string, election_date string"),
    )


def walk(pages, edges, roots):
    """A crawl from every root, and the unread pages below each page it reached."""
    out = {}
    known = dict(pages)
    for root in {r for r, *_ in roots}:
        level, seen = [(root, None)], {}
        while level:
            here = {}
            for url, parent in level:
                if url not in seen and (url not in here or parent < here[url]):
                    here[url] = parent
            depth = 1 + max([d for _, d in seen.values()], default=-1)
            seen |= {u: (p, depth) for u, p in here.items()}
            level = [(c, u) for u in here if u in known and not known[u] for p, c in edges if p == u and c is not None]
        unread = {u: int(u not in known) for u in seen}
        for u, (p, _) in sorted(seen.items(), key=lambda x: -x[1][1]):
            if p is not None:
                unread[p] += unread[u]
        out |= {(root, u): (p, d, u in known, bool(known.get(u)), unread[u]) for u, (p, d) in seen.items()}
    return out


def test_reach_and_unread_pages(spark):
    pages, edges, roots = frames(spark)
    got = {(r.root_url, r.url): (r.parent_url, r.depth, r.read, r.leaf, r.unread) for r in traversal.traverse(pages, edges, roots).collect()}
    assert got == walk(PAGES, EDGES, ROOTS)
    assert got["r1", "r1"] == (None, 0, True, False, 0) and got["r1", "c1"][0] == "a"
    # Gaps at two depths count at the root; a leaf's links are not followed.
    assert got["r2", "r2"][4] == 3 and got["r2", "d"][4] == 1 and ("r2", "c2") not in got and ("r1", "beyond") not in got
    assert got["r3", "r3"] == (None, 0, False, False, 1)


def test_only_complete_elections_give_page_sets(spark):
    pages, edges, roots = frames(spark)
    found = traversal.traverse(pages, edges, roots)
    elections = traversal.election_completeness(found, roots)
    assert {r.root_url: (r.pages, r.municipality_pages, r.unread, r.complete) for r in elections.collect()} == {
        "r1": (5, 2, 0, True), "r2": (7, 1, 3, False), "r3": (1, 0, 1, False)}
    leaves = traversal.complete_leaves(pages, found, elections).collect()
    assert {(r.url, r.category) for r in leaves} == {("c1", "camera"), ("c2", "camera")}
    assert {tuple(r) for r in traversal.tree_edges(found).collect()} == {("a", "c1"), ("b", "c2"), ("d", "c3")}


def test_elections_that_are_not_offered(spark):
    pages, edges, roots = frames(spark)
    found = traversal.traverse(pages, edges, roots)
    asked = roots.selectExpr("*", "CASE url WHEN 'r1' THEN 'unavailable' WHEN 'r2' THEN 'available' END AS availability")
    got = {r.root_url: (r.available, r.pages, r.complete) for r in traversal.election_completeness(found, asked).collect()}
    assert got == {"r1": (False, 0, True), "r2": (True, 7, False), "r3": (False, 0, True)}
    assert traversal.complete_leaves(pages, found, traversal.election_completeness(found, asked)).count() == 0


def test_empty_tables(spark):
    pages, edges, roots = frames(spark)
    assert traversal.traverse(pages, edges, roots.limit(0)).count() == 0
    alone = traversal.traverse(pages.limit(0), edges.limit(0), roots)
    assert {(r.url, r.read, r.unread) for r in alone.collect()} == {("r1", False, 1), ("r2", False, 1), ("r3", False, 1)}
