"""Plain versions of the operators' results, over Python lists of rows."""

import collections
import hashlib
import re

import xxhash

WS = "[\x20\x09-\x0d]"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lines(docs, least):
    """{doc_id: (n_lines, n_dropped, sha)} of rows (doc_id, text); repeated rows are one document."""
    key = lambda x: ascii_lower(re.sub(f"^{WS}+|{WS}+$", "", x))
    found = collections.Counter(k for _, t in set(docs) for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (key(x) and found[key(x)] >= least)]
        out[i] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def decontaminate(docs, items, window=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a:a + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a:a + n])):
                    hit |= set(range(a, a + n))
                    ids |= found
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


def simhash(docs, size=4, radius=4):
    fps = {}
    for i, t in docs:
        w = words(ascii_lower(t or ""))
        s = [" ".join(w[a:a + size]) for a in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    of = collections.defaultdict(list)
    for i, f in fps.items():
        of[f].append(i)
    for ids in of.values():
        for j in ids[1:]:
            a, b = sorted((find(ids[0]), find(j)))
            root[b] = a
    unique = sorted(of)
    for n, f in enumerate(unique):
        for g in unique[n + 1:]:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(of[f][0]), find(of[g][0])))
                root[b] = a
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def substrings(docs, length=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = words(t), set()
        for a in range(len(w) - length + 1):
            key = tuple(w[a:a + length])
            if key in seen:
                gone |= set(range(a, a + length))
            seen.add(key)
        out[i] = (len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def targets(rows):
    """{source: (size, target)} of rows (source, text): repeated sharing until none is above."""
    sizes = collections.Counter()
    for s, t in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    total, aim, free = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    rest = total
    while free and rest > 1e-9:
        w = sum(weight[s] for s in free)
        share = rest / w
        rest = 0.0
        for s in list(free):
            aim[s] += share * weight[s]
            if aim[s] >= 2 * sizes[s]:
                rest += aim[s] - 2 * sizes[s]
                aim[s] = 2.0 * sizes[s]
                free.discard(s)
    return {s: (sizes[s], aim[s]) for s in sizes}


SECRETS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def secrets(text):
    spans = []
    for n, (kind, (pattern, ok)) in enumerate(SECRETS.items()):
        spans += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m)]
    spans.sort()
    count = collections.Counter(s[2] for s in spans)
    return count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))


def quality_base(text):
    w = words(text)
    text = text or ""
    runs = collections.defaultdict(list)
    for a in range(len(w) - 7):
        runs[tuple(w[a:a + 8])].append(a)
    repeat = {a + n for starts in runs.values() if len(starts) > 1 for a in starts for n in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)


def alignment(docs, byte_tokenizer, byte_texts, pieces):
    """Rows (doc_id, text) to (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), by the tokens that hold each byte."""
    rows, held = [], collections.Counter()
    for i, text in docs:
        a = byte_tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a, bytes_b = [byte_texts[x] for x in a], []
        for x in b:
            p = pieces.id_to_piece(x)
            bytes_b.append(bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode())
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            rows.append((i, [], [], [], []))
            continue
        of_a = [n for n, x in enumerate(bytes_a) for _ in x]
        of_b = [n for n, x in enumerate(bytes_b) for _ in x]
        links = list(dict.fromkeys(zip(of_a, of_b, strict=True)))
        groups, start = [], 0
        for at in range(len(of_a)):
            if at + 1 == len(of_a) or (of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1]):
                groups.append(",".join(str(a[n]) for n in dict.fromkeys(of_a[start:at + 1])) + "|" + ",".join(str(b[n]) for n in dict.fromkeys(of_b[start:at + 1])))
                start = at + 1
        pairs = [(a[x], b[y]) for x, y in links]
        held.update(set(pairs))
        rows.append((i, a, b, groups, pairs))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return {i: (len(a), len(b), len(groups), len(pairs), sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs),
                sha(";".join(groups)) if a else "") for i, a, b, groups, pairs in rows}


def cheapest_edits(rows):
    """Rows (initial, must be deleted, truncated) to (cost, audit): every edit sequence no dearer than deleting all rows."""
    found = []

    def go(i, kept, cost, audit, inserted):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", kept):
            found.append((cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, kept + r, cost + 2, audit + "I", inserted + 1)
        if i < len(rows):
            initial, must, late = rows[i]
            go(i + 1, kept, cost + 3, audit + "D", 0)
            if not must:
                go(i + 1, kept + (initial or "x"), cost + late, audit + "K", 0)
                for r in "ua":
                    go(i + 1, kept + r, cost + 2 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)
