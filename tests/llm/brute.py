"""Plain Python forms of the operators, for small inputs."""

import hashlib
import re


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def ngram_join(docs, n=5, similar=80):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    ids, groups = sorted(sets), Sets(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def suffix_dedup(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def line_dedup(docs, chars=50, lines=8):
    """Texts without later repeated runs of lines."""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        all_ = (t or "").split("\n")
        at = [i for i, x in enumerate(all_) if words(x)]
        text = [all_[i] for i in at]
        gone = set()
        for lo in range(len(text)):
            for hi in range(lo + 1, min(len(text), lo + lines) + 1):
                run = tuple(text[lo:hi])
                if sum(map(len, run)) >= chars or hi - lo == lines:
                    if seen.setdefault(run, (d, lo)) != (d, lo):
                        gone.update(at[lo:hi])
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(all_) if i not in gone)
    return out


def cosine_links(rows, least=0.95):
    import numpy as np

    unit = {}
    for i, v in rows.items():
        if v and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v)
    groups, links = Sets(rows), dict.fromkeys(rows, 0)
    ids = sorted(unit)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i)) for i in rows}


def mixture(docs, mix):
    """Water filling and seeded prefixes in plain integers; docs as (doc_id, text, lang, source)."""
    from fractions import Fraction

    def domain(s):
        m = re.search(r"([0-9]{1,9})$", s or "")
        return f"d{int(m[1]) % 4}" if m else "other"

    rows = [(i, (domain(s), g or "", s or ""), len(words(t))) for i, t, g, s in docs]
    rows = [r for r in rows if r[2]]
    supply = {}
    for _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    cap = {leaf: n * mix.MAX_EPOCHS for leaf, n in supply.items()}
    budgets = {(): min(sum(supply.values()) * mix.SHARE // 100, sum(cap.values()))}
    for k in range(3):
        below = {}
        for leaf, c in cap.items():
            below.setdefault(leaf[:k], {}).setdefault(leaf[: k + 1], 0)
            below[leaf[:k]][leaf[: k + 1]] += c
        fresh = {}
        for parent, kids in below.items():
            w = {x: mix.WEIGHTS[mix.LEVELS[k]].get(x[k], 1) for x in kids}
            open_, left = set(kids), budgets[parent]
            while True:
                total = sum(w[x] for x in open_)
                full = [x for x in open_ if Fraction(kids[x], w[x]) <= Fraction(left, total)] if open_ else []
                if not full:
                    break
                x = min(full, key=lambda x: Fraction(kids[x], w[x]))
                fresh[x] = kids[x]
                left -= kids[x]
                open_.remove(x)
            for x in open_:
                fresh[x] = w[x] * left // sum(w[y] for y in open_)
        budgets = fresh
    out = {}
    for leaf, total in supply.items():
        epochs, rest = divmod(budgets[leaf], total)
        mine = sorted((hashlib.md5(f"{mix.SEED}:{epochs}:{i}".encode()).hexdigest(), i, n) for i, x, n in rows if x == leaf)
        for _, i, n in mine:
            whole, tail = (1, 0) if rest >= n else (0, max(0, rest))
            rest -= n
            if epochs + whole or tail:
                out[i] = (epochs + whole, tail)
    return out
