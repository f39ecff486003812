"""URL templates and media features against plain loops."""

import io
import math
import random
import time

import numpy as np
import pytest

from auditloom.llm import media, url_filter


def plain_templates(rows):
    """(host, shape): template for rows (host, shape, bad), level by level."""
    at, live, depth = {(h, s): "" for h, s, _ in rows}, {(h, s) for h, s, _ in rows}, 0
    while live:
        live = {(h, s) for h, s in live if len(s.split("/")) > depth}
        shapes, count, branch = {}, {}, {}
        for h, s in live:
            shapes.setdefault((h, at[h, s]), set()).add(s)
        for h, s, bad in rows:
            if (h, s) in live:
                c = count.setdefault((h, at[h, s]), {}).setdefault(s.split("/")[depth], [0, 0])
                if bad is not None:
                    c[0], c[1] = c[0] + 1, c[1] + bad
        labelled = {n for n, kids in count.items() if any(c[0] for c in kids.values())}
        if not labelled:
            for h, s in live:
                at[h, s] += "/*" * len(s.split("/")[depth:])
            return at
        for node, kids in count.items():
            for seg, (lab, bad) in kids.items():
                others = [c for k, c in kids.items() if k != seg]
                olab, obad = sum(c[0] for c in others), sum(c[1] for c in others)
                p, q = (bad + 0.5) / (lab + 1), (obad + 0.5) / (olab + 1)
                apart = abs(p - q) > 2 * math.sqrt(p * (1 - p) / (lab + 1) + q * (1 - q) / (olab + 1))
                branch[(*node, seg)] = seg if seg != "*" and lab and (not olab or apart) else "*"
        kept = {(t, seg) for (_, t, seg), b in branch.items() if b != "*"}
        for h, s in list(live):
            t, seg = at[h, s], s.split("/")[depth]
            if (h, t) in labelled and len(shapes[h, t]) == 1:
                at[h, s] += "/" + "/".join(s.split("/")[depth:])
                live.discard((h, s))
            else:
                known = count[h, t][seg][0] == 0 and (t, seg) in kept
                at[h, s] = f"{t}/{seg if seg != '*' and known else branch[h, t, seg]}"
        depth += 1
    return at


def low(bad, lab):
    if not lab:
        return 0.0
    p, z = bad / lab, 4 / lab
    return (p + z / 2 - math.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)


def test_templates_and_purity(spark):
    rng = random.Random(8)
    bad_share = {"en": 0.1, "de": 0.9, "shop": 0.8, "news": 0.2, "12345": 0.5, "abcdef0123": 0.5, "": 0.3}
    pages, labels = [], []
    for i in range(700):
        host = rng.choice(["a.x.com", "b.x.com", "c.y.org", "x.com", "z.net"])
        segs = rng.choices(list(bad_share), k=rng.randint(1, 4))
        pages.append((i, f"http://{host}/{'/'.join(segs)}", "t", 0, None))
        if host != "z.net" and rng.random() < (0.05 if host == "b.x.com" else 0.6):
            labels.append((i, int(rng.random() < bad_share[segs[0]])))
    pages += [*pages[:40], (None, "http://a.x.com/de/1", "t", 1, "s"), (900, None, "t", 1, "s"), (901, "no scheme", "t", 1, "s")]
    table = spark.createDataFrame(pages, "page_id long, url string, template string, lab int, seg string").repartition(3)
    got = url_filter.judge_urls(table, (), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert len(got) == len(pages)

    of = dict(labels)
    rows = []
    for page, url, *_ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, _, path = rest.partition("/")
        shape = "/".join("*" if s in ("12345", "abcdef0123", "1") else s for s in path.split("/"))
        rows.append((page, url, host, shape, of.get(page)))
    at = plain_templates([r[2:] for r in rows])
    own, wide, every, top = {}, {}, {}, {}
    for _, _, h, s, bad in rows:
        domain, t = ".".join(h.split(".")[-2:]), at[h, s]
        for table_, key in ((own, (h, t)), (wide, (domain, t)), (every, t), (top, domain)):
            c = table_.setdefault(key, [0, 0])
            if bad is not None:
                c[0], c[1] = c[0] + 1, c[1] + bad
    want = []
    for page, _, h, s, _ in rows:
        domain, t = ".".join(h.split(".")[-2:]), at[h, s]
        (l1, b1), (l2, b2), (l3, b3), (l4, b4) = own[h, t], wide[domain, t], every[t], top[domain]
        purity = (b1 + 2 * (b2 + 2 * (b3 + 2 * (b4 + 1) / (l4 + 2)) / (l3 + 2)) / (l2 + 2)) / (l1 + 2)
        best = (low(b3, l3), "all", l3, b3) if not l2 else (low(b1, l1), "host", l1, b1) if low(b1, l1) >= low(b2, l2) else (low(b2, l2), "domain", l2, b2)
        best = best if l3 else (0.0, None, 0, 0)
        want.append((str(page), t, f"{purity:.9f}", "block" if purity > 0.5 and best[0] > 0.5 else "allow", *map(str, best[1:]), f"{best[0]:.9f}"))
    assert sorted((str(r["page_id"]), r["template"], f"{r['purity']:.9f}", r["verdict"], str(r["evidence"]), str(r["evidence_pages"]), str(r["evidence_bad"]), f"{r['bound']:.9f}") for r in got) == sorted(want)
    assert {w[3] for w in want} == {"block", "allow"} and len({w[1] for w in want}) > 10


def test_long_paths_add_no_rounds(spark):
    """Three urls of sixty segments and one of a thousand, none of them in more than two rounds; a literal * is no wildcard."""
    urls = [f"http://{h}.net/" + "/".join(f"s{i}" for i in range(60)) for h in "abc"] + ["http://d.net/" + "/".join(["x"] * 1000), "http://d.net/*/y", "http://d.net/7/y"]
    labels = spark.createDataFrame([(0, 1), (3, 0)], "page_id long, bad int")
    began = time.time()
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels=labels).collect()}
    assert time.time() - began < 60 and len(got) == 6
    assert got[0]["template"] == "/" + "/".join(f"s{i}" for i in range(60)) and got[3]["template"] == "/" + "/".join(["x"] * 1000) and got[4]["template"] == "/*/*" == got[5]["template"]


def test_the_method_decides_given_pages(spark):
    """Pages without a rule are rejected where labelled pages of other hosts say so, and on evidence only."""
    got = url_filter.judge_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).filter("rule is null").collect()
    blocked = [r for r in got if r["verdict"] == "block"]
    assert blocked and all(r["evidence_pages"] >= 4 and r["bound"] > 0.5 and r["purity"] > 0.5 for r in blocked) and len(blocked) < len(got) / 2
    assert not any(r["verdict"] == "block" for r in got if r["host"] == "" or r["evidence"] is None)


def means(gray, height, width):
    """Means of cells, by repeating pixels until cells hold whole ones."""
    h, w = gray.shape
    return np.repeat(np.repeat(gray, height, 0), width, 1).reshape(height, h, width, w).mean((1, 3))


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 5000, 60_001])
def test_media_features(size):
    raw = np.random.default_rng(size).integers(32, 127, size, np.uint8).tobytes()
    payload = raw + b" " * ((-size % 192) if size else 192)
    gray = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float).mean(2)
    cells = np.round(means(gray, 8, 9), 6)
    bits = "".join(str(int(cells[i, j + 1] > cells[i, j])) for i in range(8) for j in range(8))
    for kind in ("ppm", "bmp"):
        row = media.media_row(raw, kind)
        assert row[6].split(":")[0] == f"{int(bits, 2):016x}"
        tile = np.load(io.BytesIO(row[7]))
        assert tile.dtype == np.uint8 and tile.shape == (16, 16) and np.abs(tile - means(gray, 16, 16)).max() <= 0.5 + 1e-6
