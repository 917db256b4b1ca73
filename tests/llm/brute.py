"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text):
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, linked):
    """Smallest id of each row's component: rows are (id, value)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(rows))]


def simhash(rows):
    prints = [(k, fingerprint(t)) for k, t in rows]
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    return [(k, f"{f:016x}", r) for (k, f), r in zip(prints, roots, strict=True)]


def repeats(rows, k=20):
    """rows: (id, text) with distinct ids."""
    words = {d: SPACE.findall(t or "") for d, t in rows}
    seen, gone = {}, defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            if seen.setdefault(tuple(words[d][i : i + k]), (d, i)) != (d, i):
                gone[d] |= set(range(i, i + k))
    return [(d, len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in words.items()]


def licenses(rows, phrases):
    out = []
    for d, t in rows:
        w = PLAIN.findall(lower(t))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        out.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    return out


def contamination(rows, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = PLAIN.findall(lower(t))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(None if item is None else str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, t in rows:
        w, hit, found = PLAIN.findall(lower(t)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def line_runs(rows, min_lines=2, min_chars=100):
    """rows: (id, text) with distinct ids; (id, n_lines, n_removed, n_left, kept text)."""
    cut = {d: None if t is None else t.split("\n") for d, t in rows}
    filled = {d: [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate(c or []) if x.strip(" \t\r\f\x0b")] for d, c in cut.items()}
    seen, gone = {}, defaultdict(set)
    for d in sorted(filled):
        f = filled[d]
        for n in {1, min_lines}:
            for p in range(len(f) - n + 1):
                run = tuple(x for _, x in f[p : p + n])
                if seen.setdefault(run, (d, p)) != (d, p) and (n >= min_lines or len(run[0]) >= min_chars):
                    gone[d] |= {i for i, _ in f[p : p + n]}
    return [
        (d, len(c or []), len(gone[d]), len(filled[d]) - len(gone[d]), None if c is None else "\n".join(x for i, x in enumerate(c) if i not in gone[d]))
        for d, c in cut.items()
    ]


def maximal_runs(rows, min_lines):
    """(id, first line, last line, lines) of runs that stand elsewhere too and can't be made longer at either end."""
    f = {d: [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\x0b")] for d, t in rows}
    places = [(d, p) for d in f for p in range(len(f[d]))]
    out = []
    for d, lines in f.items():
        held = -1
        for p in range(len(lines)):
            best = 0
            for e, q in places:
                n = 0
                while (e, q) != (d, p) and p + n < len(lines) and q + n < len(f[e]) and lines[p + n][1] == f[e][q + n][1]:
                    n += 1
                best = max(best, n)
            if p + best > held and best >= min_lines:
                out.append((d, lines[p][0], lines[p + best - 1][0], best))
            held = max(held, p + best)
    return out


def license_labels(rows, templates, drift=3, least=0.6):
    """(id, labels, score): votes of each diagonal, merged spans and their words, template by template."""
    out = []
    for d, text in rows:
        w, labels, loose, score = PLAIN.findall(lower(text)), set(), [], 0.0
        w = [x.encode() for x in w]
        for t in templates:
            grams, votes = defaultdict(list), defaultdict(set)
            for i in range(len(t.words) - t.k + 1):
                grams[tuple(t.words[i : i + t.k])].append(i)
            for p in range(len(w) - t.k + 1):
                for i in grams.get(tuple(w[p : p + t.k]), ()):
                    votes[p - i].add(i)
            spans = []
            for g in sorted(votes):
                if spans and not t.exact and g - spans[-1][-1] <= drift:
                    spans[-1].append(g)
                else:
                    spans.append([g])
            for span in spans:
                share = len(set().union(*(votes[g] for g in span))) / (len(t.words) - t.k + 1)
                score = max(score, share)
                if share >= (1 if t.exact else least):
                    equal = {i + j for g in span for i in votes[g] for j in range(t.k)}
                    if t.exact:
                        labels.add(t.label)
                    elif len(equal) / len(t.words) >= least:
                        loose.append((-len(equal), -len(equal) / len(t.words), t.label, min(g + min(votes[g]) for g in span), max(g + max(votes[g]) for g in span) + t.k))
        taken = []
        for x in sorted(loose):
            if all(x[4] <= a or b <= x[3] for a, b in taken):
                taken.append((x[3], x[4]))
                labels.add(x[2])
        out.append((d, ",".join(sorted(labels)), score))
    return out


def languages(pages, model, trigrams, spoken, strength=5.0, most=40, declared_weight=0.8):
    """pages: (id, url, html); (id, declared, text_language, language, confidence, grams) from the evidence of all pages."""
    names, n = model.languages, len(model.languages)

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def group(pattern, text):
        m = re.search(pattern, text or "", re.I | re.S)
        return m[1].lower() if m else None

    rows = []
    for i, url, html in pages:
        host = group(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url)
        text = re.sub(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ", html or "", flags=re.I | re.S)
        slots = trigrams(text)
        logs = model.logs[slots].mean(axis=0, dtype=np.float64) * min(len(slots), most) if len(slots) else np.zeros(n)
        rows.append((i, group(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html), (host, group(r"([^.]+\.[^.]+)$", host), group(r"\.([^.]+)$", host)), logs, len(slots)))
    table = np.full((n, n), strength * (1 - declared_weight) / (n - 1))
    np.fill_diagonal(table, strength * declared_weight)
    for _, d, _, logs, grams in rows:
        if d in names and grams:
            table[names.index(d)] += softmax(logs)
    table /= table.sum(axis=0)
    both = [logs + (np.log(table[names.index(d)]) if d in names else 0) for _, d, _, logs, _ in rows]
    own = [softmax(b) for b in both]
    sums = defaultdict(lambda: np.zeros(n))
    for (_, _, (host, domain, suffix), _, _), r in zip(rows, own, strict=True):
        for key in (("root",), (suffix,), (domain, suffix), (host, domain, suffix)):
            sums[key] += r
    root = (sums[("root",)] + 1) / (sums[("root",)] + 1).sum()
    out = []
    for (i, d, (host, domain, suffix), logs, grams), b, r in zip(rows, both, own, strict=True):
        extra = np.array([0.5 ** [x for x in spoken.get(suffix, "").split() if x in names].index(x) if x in spoken.get(suffix, "").split() else 0.0 for x in names])
        p1 = sums[(suffix,)] + strength * root + strength * extra / (extra.sum() or 1)
        p2 = sums[(domain, suffix)] + strength * p1 / p1.sum()
        post = softmax(b + np.log(np.maximum(sums[(host, domain, suffix)] - r, 0) + strength * p2 / p2.sum()))
        out.append((i, d, names[logs.argmax()] if grams else None, names[post.argmax()], round(float(post.max()), 6), grams))
    return out
