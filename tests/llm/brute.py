"""Plain Python versions of what the operators of this subpackage compute, for small tables."""

import re
from urllib.parse import unquote

from tests.brute import NUM, Groups, area_shared, extent, rows


def patch_groups(d):
    g, box, names = Groups(), {}, {}
    for r in rows(d, "one_tile"):
        g.find(r["patch_id"])
        if e := extent(r["geometry"]):
            box[r["patch_id"]] = e
        for path in (r["images_path"], r["labeltxt_path"]):
            if path is not None:
                name = unquote(path).replace("\\", "/").split("/")[-1].strip().lower()
                if name.count("__") > 1:
                    raster = name[name.index("__") + 2:name.rindex("__")].strip()
                    g.join(names.setdefault(raster, r["patch_id"]), r["patch_id"])
    ids = sorted(box)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if area_shared(box[a], box[b]):
                g.join(a, b)
    return {(k, g.find(k)) for k in list(g.up)}


def detection_groups(d):
    by = {}
    for r in rows(d, "object_detection"):
        if r["score"] is not None and r["score"] > 0.5 and r["label"] is not None and (e := extent(r["geometry"])):
            by.setdefault(r["label"].strip().lower(), {})[r["det_id"]] = e
    g = Groups()
    for box in by.values():
        ids = sorted(box, key=lambda k: box[k][0])
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                if box[b][0] >= box[a][2]:
                    break
                if area_shared(box[a], box[b]):
                    g.join(a, b)
    return {(k, g.find(k)) for k in list(g.up)}


def label_objects(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        f = line.split()
        if len(f) >= 9 and all(re.fullmatch(NUM, x) for x in f[:8]):
            n = [float(x) for x in f[:8]]
            out.append((f[8].lower(), min(n[::2]), min(n[1::2]), max(n[::2]), max(n[1::2])))
    return out


def cross_split(d):
    p = {}
    for r in rows(d, "one_tile"):
        s = (r["split_name"] or "").strip().lower()
        o, e = label_objects(r["labeltxt"]), extent(r["geometry"])
        if e and o and s in ("train", "val", "validation", "test"):
            p[r["patch_id"]] = (s == "train", e, o)

    def agree(a, b):
        return sum(any(x[0] == y[0] and all(abs(x[i] - y[i]) <= 8 for i in range(1, 5)) for y in b) for x in a) >= 0.75 * len(a)

    out = set()
    for a, (ta, ea, oa) in p.items():
        for b, (tb, eb, ob) in p.items():
            if a < b and ta != tb and area_shared(ea, eb):
                i = (min(ea[2], eb[2]) - max(ea[0], eb[0])) * (min(ea[3], eb[3]) - max(ea[1], eb[1]))
                u = sum((e[2] - e[0]) * (e[3] - e[1]) for e in (ea, eb)) - i
                if i / u >= 0.8 and agree(oa, ob) and agree(ob, oa):
                    out.add((a, b))
    return out


def oversized(d):
    out = set()
    res = {r["raster_id"]: r["res"] for r in rows(d, "raster")}
    for g in rows(d, "grid"):
        e = extent(g["geometry"]) or (None,) * 4
        b = [g[c] if g[c] is not None else v for c, v in zip(("minx", "miny", "maxx", "maxy"), e, strict=True)]
        if g["raster_id"] in res and max(b[2] - b[0], b[3] - b[1]) / res[g["raster_id"]] > 512 + 1e-6:
            out.add(("grid", g["cell_id"]))
    for t in rows(d, "one_tile"):
        e = extent(t["geometry"])
        if e and t["res"] and max(e[2] - e[0], e[3] - e[1]) / t["res"] > 512 + 1e-6:
            out.add(("one_tile", t["patch_id"]))
    return out


def shared_stretches(texts, span=400):
    """texts: {doc_id: text}."""
    seen = {}
    for k, t in texts.items():
        for i in range(len(t or "") - span + 1):
            seen.setdefault(hash(t[i:i + span]), set()).add(k)
    out = set()
    for k, t in texts.items():
        at = [i for i in range(len(t or "") - span + 1) if len(seen[hash(t[i:i + span])]) > 1]
        while at:
            first = last = at[0]
            n = 1
            while n < len(at) and at[n] <= last + span:
                last = at[n]
                n += 1
            out.add((k, first, last + span))
            at = at[n:]
    return out
