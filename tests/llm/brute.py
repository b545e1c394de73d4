"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(docs, items, k=10):
    """docs, items: (id, text); rows of op1."""
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        if w:
            n = min(k, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add("null" if name is None else str(name))
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n, own in windows.items():
            for i in range(len(w) - n + 1):
                if x := own.get(tuple(w[i:i + n])):
                    found |= x
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def quality(docs):
    """The base columns of op10."""
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i:i + 5]), []).append(i)
        again = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again),
                    len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return out


def simhash(docs, words=4, bits=4):
    """Rows of op3."""
    import xxhash
    prints = []
    for doc_id, text in docs:
        w = SPACED.findall(lower(text))
        sh = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    members = {}
    for i, (doc_id, _) in enumerate(docs):
        members.setdefault(root(i), []).append(doc_id)
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(docs[i][0], f"{prints[i]:016x}", least[root(i)]) for i in range(len(docs))]


def sentence_spans(text):
    """Start and end of the sentences of each line: white space behind an end mark parts them, an ideographic one does alone."""
    out, begin, i = [], 0, 0
    ends, closing, alone = ".!?…‼⁇⁈⁉․‥．！？﹒﹖﹗。｡", "\"'’”)]＂＇）］", "。｡"
    while i < len(text):
        c, last = text[i], text[i - 1] if i > begin else ""
        after_end = last and (last in ends or last in closing and i - 2 >= 0 and text[i - 2] in ends and text[i - 2] != "\n")
        if c == "\n":
            out.append((begin, i))
            begin = i = i + 1
        elif c.isspace() and after_end:
            out.append((begin, i))
            while i < len(text) and text[i].isspace() and text[i] != "\n":
                i += 1
            begin = i
        elif last and last in alone and not c.isspace():
            out.append((begin, i))
            begin = i
            i += 1
        else:
            i += 1
    return out + [(begin, len(text))]


def line_dedup(docs, min_words=50, sentences=False):
    """doc_id and text left; docs in the order of rank."""
    import unicodedata
    seen, out = set(), []
    for doc_id, text in docs:
        text_ = text or ""
        if sentences:
            places = sentence_spans(text_)
        else:
            ends = [m.start() for m in re.finditer("\n", text_)] + [len(text_)]
            places = list(zip([0] + [e + 1 for e in ends[:-1]], ends))
        units = [text_[a:b] for a, b in places]
        keys = [" ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in units]
        again = []
        for k in keys:
            again.append(None if not k else k in seen)
            seen.add(k)
        drop, i = set(), 0
        while i < len(units):
            if not again[i]:
                i += 1
                continue
            j = i
            while j < len(units) and again[j] is not False:
                j += 1
            if sum(len(units[k].split()) for k in range(i, j)) >= min_words:
                drop |= set(range(i, j))
            i = j
        # what stays is joined as it stood, and by a line end where something went
        parts = []
        for n, place in enumerate(places):
            if n not in drop:
                if parts and n - 1 not in drop:
                    parts[-1] = (parts[-1][0], place[1])
                else:
                    parts.append(place)
        out.append((doc_id, None if text is None else "\n".join(text[a:b] for a, b in parts) if drop else text))
    return out


def secrets(docs):
    """The base columns of op6."""
    kinds = [("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(kinds)
                 for m in p.finditer(text or "") if len(m[g]) >= least]
        spans.sort()
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)
        out.append((doc_id, *n, hashlib.sha256(joined.encode()).hexdigest()))
    return out


PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def licenses(docs):
    """The base columns of op5."""
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        at = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        out.append((doc_id, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return out


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def merkle(docs):
    """docs: (doc_id, source, lang, n_chars, text); rows of op12."""
    import zlib

    def h(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def paths(level):
        """The top node, and for each leaf its runs as (place, run), from below."""
        own, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[i:i + 8] for i in range(0, len(level), 8)]
            for j, p in enumerate(at):
                own[j].append((p % 8, runs[p // 8]))
            at = [p // 8 for p in at]
            level = [h("".join(r)) for r in runs]
        return level[0], own

    groups = {}
    for r in docs:
        t = r[4]
        if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            t = lower(t)
        groups.setdefault(r[2], []).append((r[0], leaf(r), leaf((*r[:4], t))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(paths([x[1] for x in groups[g]]))
    if not names:
        return []
    root, above = paths([t for t, _ in tops])
    out = []
    for g, (sub, own), up in zip(names, tops, above):
        for (doc_id, a, fold), path in zip(groups[g], own):
            proof = ""
            for i, run in path + up:
                proof += "".join(run[:i] + run[i + 1:])
                fold = h("".join(run[:i] + [fold] + run[i + 1:]))
            out.append((doc_id, a, sub, root, h(proof), fold, fold == root))
    return out


def collocations(docs, least=100, top=2000, longest=5):
    """docs: (text, lang); rows of op13."""
    from collections import Counter
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + k] for q, a in cands.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if a >= counts[q[i:i + k]]}
        rows = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return out
