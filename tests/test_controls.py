"""Cell-line enrichment against a plain count."""

import math
import random

from pyspark.sql import functions as F

from ripplerank.operators import controls, ranks


def test_line_enrichment(spark, monkeypatch):
    rng = random.Random(6)
    genes = [f"g{i:03d}" for i in range(90)]
    scored = [(f, g, int(rng.random() < 0.15), round(rng.random(), 2)) for f in ("f0", "f1", "few") for g in (genes if f != "few" else genes[:25])]
    essential = [(g, f"l{j}") for j in range(5) for g in genes if rng.random() < 0.1 + 0.1 * j] + [("g001", "l9"), ("nowhere", "l0")]
    measured = [g for g in genes if rng.random() < 0.85]
    ks, want = (0.1, 30), {}
    for f in ("f0", "f1", "few"):
        rows = [r for r in scored if r[0] == f]
        order = [r[1] for r in sorted((r for r in rows if not r[2]), key=lambda r: (-r[3], r[1]))]
        for k in ks:
            n = min(math.ceil(k * len(rows)) if k < 1 else k, len(order))
            if len(order) - n < 20:
                continue
            cand, back = ([g for g in part if g in measured] for part in (order[:n], order[n:]))
            if len(cand) < 5 or len(back) < 20:
                continue
            for line in {x for _, x in essential}:
                need = {g for g, x in essential if x == line}
                a, b, m = len(need & set(cand)), len(need & set(back)), len(cand) + len(back)
                if b:
                    p = sum(math.comb(len(cand), i) * math.comb(m - len(cand), b - i) for i in range(a, min(len(cand), b) + 1) if b - i <= m - len(cand)) / math.comb(m, b)
                    want[f, float(k), line] = (a, b, len(cand), m, round(p, 9))
    df = spark.createDataFrame(scored, "fold string, gene string, y int, score double")
    tables = df, spark.createDataFrame(essential + essential[:9], "gene string, line string"), spark.createDataFrame([(g,) for g in measured], "gene string")
    for _ in range(2):
        out = controls.line_enrichment(*tables, ["fold"], ks).collect()
        got = {(r["fold"], r["k"], r["line"]): (r["hits"], r["hits_rest"], r["candidates"], r["population"], round(r["p"], 9)) for r in out}
        assert got == want and len(want) > 12
        monkeypatch.setattr(ranks, "GROUP_ROWS", 20)  # the same by ranges
    s = {r["k"]: r for r in controls.enrichment_summary(controls.line_enrichment(*tables, ["fold"], ks), [], ["fold"]).collect()}
    ps = sorted(v[4] for k, v in want.items() if k[1] == 0.1)
    assert s[0.1]["n_lines"] == len(ps) and abs(s[0.1]["least_p"] - ps[0]) < 1e-9 and abs(s[0.1]["below_05"] - sum(p < 0.05 for p in ps) / len(ps)) < 1e-9
    assert controls.line_enrichment(df.limit(0), *tables[1:], ["fold"]).count() == 0
    assert controls.line_enrichment(df.where(F.col("fold") == "few"), *tables[1:], ["fold"]).count() == 0
