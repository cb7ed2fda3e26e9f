"""Plain Python versions of what the operators compute, for small tables."""

import re

import pyarrow.parquet as pq

NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def rows(d, name, columns=None):
    return pq.read_table(f"{d}/{name}.parquet", columns=columns).to_pylist()


def extent(wkt):
    if wkt is None:
        return None
    body = wkt.split(";")[-1]
    if "(" not in body:
        return None
    pts = [p.strip(" ()").split() for p in body[body.index("("):].split(",")]
    xs, ys = [float(p[0]) for p in pts], [float(p[1]) for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def area_shared(a, b):
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(d, radius=25.0):
    p = {r["seg_id"]: e for r in rows(d, "segments_gdf") if r["dfm"] in (None, 1, 2) and (e := extent(r["geometry"]))}
    p = {k: ((e[0] + e[2]) / 2, (e[1] + e[3]) / 2) for k, e in p.items()}
    ids = sorted(p)
    out = {("near", a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2 <= radius**2}
    for g in rows(d, "grid"):
        e = extent(g["geometry"]) or (None,) * 4
        b = [g[c] if g[c] is not None else v for c, v in zip(("minx", "miny", "maxx", "maxy"), e, strict=True)]
        out |= {("inside", a, g["cell_id"]) for a in ids if b[0] <= p[a][0] <= b[2] and b[1] <= p[a][1] <= b[3]}
    return out


def records(d):
    first = {}
    for r in sorted(rows(d, "prediction_file"), key=lambda r: r["file_id"]):
        text = (r["content"] or "").removeprefix("\ufeff")
        for n, line in enumerate(re.split("\r?\n", text), 1):
            f = re.split(r"[ \t]+", line.strip(" \t\r"))
            if len(f) == 10 and all(re.fullmatch(NUM, x) for i, x in enumerate(f) if i != 4):
                first.setdefault((f[4].lower(), *[float(x) for i, x in enumerate(f) if i != 4]), (r["file_id"], n))
    return set(first.values())
