"""Every reference group of an expansion has one row with the reason why it added nothing."""

from anvilgrid.operators import citations
from anvilgrid.plans import catalogue

SEEDS = "query_id long, chunk_id long, pos long"
RESOLVED = "parent_id long, ref long, type string, status string, target_id long, position long"
GROUPS = [
    (1, 0, "internal", "resolved", 10, 0), (1, 0, "internal", "resolved", 11, 1), (1, 1, "internal", "resolved", 2, 2), (1, 2, "external", "target_heading_not_found", None, None),
    (2, 0, "internal", "resolved", 10, 0), (2, 1, "internal", "resolved_descendant", 12, 3), (10, 0, "internal", "resolved", 13, 4), (10, 1, "internal", "resolved", 1, 5),
]


def statuses(frame):
    rows = frame.collect()
    out = {(r["depth"], r["parent_id"], r["ref"]): (r["status"], r["added"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_ranked(spark):
    seeds, resolved = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], SEEDS), spark.createDataFrame(GROUPS, RESOLVED)
    scores = spark.createDataFrame([(10, 0.9), (11, 0.1), (12, 0.2), (13, 0.5)], "chunk_id long, score double")
    for strategy in ("semantic", "rrf"):
        got = statuses(citations.ranked_trail(seeds, resolved, lambda c: c.join(scores, "chunk_id"), strategy, depth=2, per_depth=1))
        assert got == {
            (1, 1, 0): ("resolved", 1), (1, 1, 1): ("duplicate_target", 0), (1, 1, 2): ("target_heading_not_found", 0), (1, 2, 0): ("duplicate_target", 0),
            (1, 2, 1): (f"not_selected_by_{strategy}_score", 0), (2, 10, 0): ("resolved", 1), (2, 10, 1): ("duplicate_target", 0),
        }


COVER = {1: 0.1, 2: 0.3, 10: 0.9, 11: 0.2, 12: 0.6, 13: 0.95, 14: 0.2}


def cover(spark):
    table = spark.createDataFrame([(c, [x, 0.0]) for c, x in COVER.items()], "chunk_id long, cover array<double>")
    return lambda rows: rows.join(table, "chunk_id")


def test_gain(spark):
    seeds, resolved = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], SEEDS), spark.createDataFrame([*GROUPS[:6], (2, 2, "internal", "resolved", 14, 6)], RESOLVED)
    picks, trail = citations.gain_expansion(seeds, resolved, cover(spark), per_depth=1)
    assert statuses(trail) == {
        (1, 1, 0): ("resolved", 1), (1, 1, 1): ("duplicate_target", 0), (1, 1, 2): ("target_heading_not_found", 0), (1, 2, 0): ("duplicate_target", 0),
        (1, 2, 1): ("not_selected_by_gain", 0), (1, 2, 2): ("below_min_gain", 0),
    }
    assert [(r.parent_id, r.chunk_id, round(r.gain, 6)) for r in picks.collect()] == [(1, 10, 0.8)]
    best = {(r.parent_id, r.ref): r.best and round(r.best, 6) for r in trail.collect()}
    assert best[1, 0] == 0.8 and best[2, 1] == 0.3 and best[1, 1] is None


def plain_gain(seeds, groups, depth, slots, per_heading, least):
    """The greedy rule, one question, on plain lists; facets as COVER has them."""
    chosen, out, frontier = set(seeds), [], list(seeds)
    for d in range(1, depth + 1):
        cover_of, found = {p: COVER[p] for p in frontier}, {}
        order = 0
        for p in frontier:
            for ref in sorted({g[1] for g in groups if g[0] == p}):
                targets = [(max(0, COVER[g[4]] - COVER[p]), g[5], g[4]) for g in groups if g[:2] == (p, ref) and g[4] is not None and g[4] not in chosen]
                for _, _, t in sorted(targets, key=lambda x: (-round(x[0], 9), x[1]))[:per_heading]:
                    found.setdefault((p, t), order)
                    order += 1
        picked = []
        while found and len(picked) < slots:
            gain, o, p, t = min((-round(max(0, COVER[t] - cover_of[p]), 12), o, p, t) for (p, t), o in found.items())
            if -gain <= 0 or -gain + 1e-12 < least:
                break
            cover_of[p] = max(cover_of[p], COVER[t])
            picked.append(t)
            out.append((d, p, t, round(-gain, 6)))
            found = {k: v for k, v in found.items() if k[1] != t}
        chosen |= set(picked)
        frontier = picked
    return out


def test_gain_over_depths_is_the_plain_rule(spark):
    more = [*GROUPS, (10, 2, "internal", "resolved", 14, 7), (12, 0, "internal", "resolved", 13, 4), (12, 1, "internal", "resolved", 11, 1)]
    seeds, resolved = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], SEEDS), spark.createDataFrame(more, RESOLVED)
    for slots, per_heading in ((1, 4), (2, 1), (4, 4)):
        picks, trail = citations.gain_expansion(seeds, resolved, cover(spark), 3, slots, per_heading)
        got = [(r.depth, r.parent_id, r.chunk_id, round(r.gain, 6)) for r in picks.orderBy("depth", "rank").collect()]
        assert got == plain_gain([1, 2], more, 3, slots, per_heading, 0.01) and len(got) > 1
        assert trail.where("added > 0").agg({"added": "sum"}).first()[0] == len(got)


def test_query_counts_every_group(spark):
    rows = catalogue.citation_trail(spark, "/root/testdata/sf0.001").collect()
    total = {s: sum(r["n"] for r in rows if r["strategy"] == s) for s in ("semantic", "gain")}
    assert total["semantic"] == total["gain"] > 0 and {r["status"] for r in rows} & {"not_selected_by_semantic_score", "not_selected_by_gain"}
