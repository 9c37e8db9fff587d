"""Plain versions of the numbered queries, for small tables: dict of doc_id to the contract's columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op1(docs, tokenizer):
    out = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out[d] = (len(ids), sha(raw), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def luhn(s):
    s = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(s)) % 10 == 0


def op2(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        e = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        i = [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        c = [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and luhn(x)]
        p = [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        out[d] = (len(e), len(i), len(c), len(p), sha(listed(e + i + c + p)), e + i + c + p)
    return out


def op3(docs):
    out = {}
    for d, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        out[d] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def op3_labels(docs, templates, containment):
    out = defaultdict(set)
    longest = max(len(w.split()) for _, w in templates)
    for d, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        lines = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line) for line in low.split("\n")]
        blocks = [w for w in lines if len(w) <= 2 * longest]
        if len(lines) > 1 or len(blocks) < len(lines):
            every = [w for line in lines for w in line]
            blocks += [every[i : i + 2 * longest] for i in range(0, len(every), longest)]
        for b in map(set, blocks):
            for label, wording in templates:
                own = set(wording.split())
                if len(b & own) >= containment * len(own) - 1e-9:
                    out[d].add(label)
    return out


def op4_pieces(docs, tokenizer, length=2048):
    out = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), length)):
            part = ids[s : s + length]
            out[d, k] = (s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def op5(pages):
    out = {}
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for p, url in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + r), h + r, v) for h, r, v in rules if (host == h or host.endswith("." + h)) and path.startswith(r)]
        out[p] = (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None)
    return out


def op7(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                cover |= set(range(i, i + 8))
        n, r = len(w), len(cover)
        out[d] = (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)
    return out


def shingle_set(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op8(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    ids = sorted(sets, key=lambda d: len(sets[d]))
    index, links = defaultdict(list), []
    for d in ids:
        met = Counter(x for s in sets[d] for x in index[s])
        for x, both in met.items():
            if 100 * both >= 80 * (len(sets[d]) + len(sets[x]) - both):
                links.append((d, x))
        for s in sets[d]:
            index[s].append(d)
    comp = smallest_reachable(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def op9(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        a = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        k = [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        h = [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        spans = sorted(a + k + h, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        out[d] = (len(a), len(k), len(h), sha(listed(spans)), spans)
    return out


def _without_repeats(docs):
    ws = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(ws):
        for i in range(len(ws[d]) - 49):
            first.setdefault(tuple(ws[d][i : i + 50]), d)
    for d, w in ws.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def op10(docs):
    return {d: (n, gone, sha(kept)) for d, n, gone, kept in _without_repeats(docs)}


def op10_kept(docs):
    """Texts that lost words; None for the others."""
    return {d: kept if gone else None for d, _, gone, kept in _without_repeats(docs)}


def op11(rows, k=16, rounds=3):
    """rows: (vec_id, components)."""
    kept = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    cent = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            cent[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, j in got:
        by[j] += d
    marks = [sha(",".join(map(str, c))) for c in cent]
    return sorted(((i, j, d, by[j], sum(by.values()), marks[j]) for i, d, j in got), key=str)


def op12_targets(rows):
    """rows: (doc_id, text, source); target of each source by repeated resharing, in exact fractions."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(3 * sum(size.values()), 2)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = {s for s in free if share[s] > 2 * size[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = Fraction(2 * size[s])
            left -= 2 * size[s]
        free -= above
    return {s: (size[s], target[s]) for s in names}


def op13(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
        ends[v].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += cost
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=str)
