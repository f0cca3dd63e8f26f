"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ENDS = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def shingles(text, width, lower=True):
    w = words((text or "").translate(LOWER) if lower else text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, width, percent):
    """id -> (set size, component); rows of unique ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": sum(c.isupper() for c in text or ""),
    }


def rules_fail(text):
    m = measures(text)
    return (
        m["n_words"] < 50,
        100 * m["n_repeat_words"] > 50 * m["n_words"],
        100 * m["n_symbols"] > 10 * m["n_words"],
        2 * m["word_chars"] < 5 * m["n_words"],
        m["word_chars"] > 10 * m["n_words"],
        100 * m["n_upper"] > 40 * m["word_chars"],
        100 * m["n_dup_lines"] > 40 * m["n_lines"],
    )


def without_boilerplate(rows, min_sites, spare_copies=False):
    """(id, site, text) -> text that stays, in order."""
    sites = {}
    for _, site, text in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line) and site is not None:
                sites.setdefault(line.strip(ENDS), set()).add(site)
    bad = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for _, _, text in rows:
        lines = (text or "").split("\n")
        gone = [WORD.search(x) is not None and x.strip(ENDS) in bad for x in lines]
        spared = spare_copies and not any(WORD.search(x) and not g for x, g in zip(lines, gone, strict=True))
        if any(gone) and not spared:
            text = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append(text)
    return out


def without_repeats(rows, width=13):
    """(id, text) -> (words, removed, digest) for unique ids."""
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def water_fill(budget, children):
    """{name: (weight, cap)} -> {name: share}, by raising a level until the budget is gone."""
    budget = min(budget, sum(cap for _, cap in children.values()))
    full, out = set(), {}
    while True:
        rest = budget - sum(children[k][1] for k in full)
        weights = sum(w for k, (w, _) in children.items() if k not in full)
        more = {k for k, (w, cap) in children.items() if k not in full and cap * weights <= w * rest}
        if not more:
            break
        # Only the child of least cap for its weight is sure; the others are tried again.
        full.add(min(more, key=lambda k: (children[k][1] / children[k][0], k)))
    for k, (w, cap) in children.items():
        out[k] = cap if k in full else min(cap, w * rest // weights)
    return out


def mix(rows, mixture, domains):
    """(doc_id, lang, source, text) -> {row index: copies}."""
    leaves = {}
    for n, (_, lang, source, _) in enumerate(rows):
        number = re.search(r"(\d+)$", source or "")
        leaves.setdefault((domains[int(number[1]) % len(domains) if number else 0], lang or "", source or ""), []).append(n)
    tokens = [len(words(t)) for *_, t in rows]
    have = {k: sum(tokens[n] for n in v) for k, v in leaves.items()}
    named = [mixture.domains, mixture.langs, mixture.sources]
    budgets = {(): sum(have.values()) * mixture.target_percent // 100}
    for depth in range(3):
        nodes = {}
        for k, n in have.items():
            nodes[k[: depth + 1]] = nodes.get(k[: depth + 1], 0) + n * mixture.max_epochs
        for parent in {k[:depth] for k in nodes}:
            own = {k: (named[depth].get(k[-1], 1), cap) for k, cap in nodes.items() if k[:depth] == parent}
            budgets |= water_fill(budgets[parent], own)
    out = {}
    for leaf, members in leaves.items():
        if not have[leaf]:
            continue
        epochs, rest = divmod(budgets[leaf], have[leaf])
        by_hash = {}
        for n in members:
            h = hashlib.md5(f"{mixture.seed}:{epochs}:{'' if rows[n][0] is None else rows[n][0]}".encode()).hexdigest()
            by_hash.setdefault(h, []).append(n)
        total, inside = 0, set()
        for h in sorted(by_hash):
            total += sum(tokens[n] for n in by_hash[h])
            if total > rest:
                break
            inside |= set(by_hash[h])
        out |= {n: epochs + (n in inside) for n in members if epochs + (n in inside)}
    return out
