"""Plain versions of the operators for small inputs: loops and sets, nothing shared with the operators but trained numbers."""

import math
from itertools import combinations

import numpy as np

from declq.llm import nn, quality_mil, toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edit_similar(a, b):
    longest = max(len(a), len(b))
    return longest - min(len(a), len(b)) <= 0.2 * longest and edit_distance(a, b) <= 0.2 * longest + 1e-9


def groups(items, linked):
    """The least item of each item's connected group."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(items), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def dedup_lines(texts):
    """doc_id: text without lines that repeat an earlier one."""
    first = {}
    for i in sorted(texts):
        for p, line in enumerate((texts[i] or "").split("\n")):
            if line.split():
                first.setdefault(" ".join(line.lower().split()), (i, p))
    lines = sorted(first)
    group = groups(range(len(lines)), lambda a, b: edit_similar(lines[a], lines[b]))
    least = {}
    for k, line in enumerate(lines):
        least[group[k]] = min(least.get(group[k], (math.inf, 0)), first[line])
    keep = {line: least[group[k]] for k, line in enumerate(lines)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.split() or keep[" ".join(x.lower().split())] == (i, p)) for i, t in texts.items()}


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def keep_one(texts):
    """The doc_ids that stay of near-duplicate groups."""
    sets = {i: shingles((t or "").lower().split()) for i, t in texts.items()}
    group = groups(texts, lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return {i for i in texts if group[i] == i}


def contains(text, item):
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    wanted = shingles(words(item))
    return bool(wanted) and len(wanted & shingles(words(text))) >= 0.8 * len(wanted)


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def word_vector(net, word):
    """Mean vector of a word's four buckets in a toxicity model."""
    return net.embedding[net.row[nn.buckets([word], toxicity.BITS)[:, 0]]].mean(0)


def toxic_logit(net, text):
    """Filters at every position, one by one: the pooled, rectified outputs into the linear unit, less the language's cut."""
    words = (text or "").lower().encode().split()
    vectors = [word_vector(net, w) for w in words] or [np.zeros(toxicity.DIM)]
    vectors += [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    pooled = []
    for k, w in enumerate(toxicity.WIDTHS):
        outs = [sum(vectors[p + j] @ net.taps[k][j] for j in range(w)) for p in range(max(len(words), 1))]
        pooled += list(np.max(outs, axis=0))
    votes = [sum(x in ws for x in words) for ws in toxicity.FUNCTION_WORDS.values()]
    lang = votes.index(max(votes)) if max(votes) and votes.count(max(votes)) == 1 else len(votes)
    hidden = [max(x + b, 0) for x, b in zip(pooled, net.bias)]
    return float(sum(h * o for h, o in zip(hidden, net.out)) + net.offset[0] - net.cuts[lang])


def quality_logit(net, text):
    """Passages one by one, gated attention over them, the weighted passage into the linear unit."""
    words = (text or "").encode().split()
    parts = [words[k : k + quality_mil.PASSAGE] for k in range(0, len(words), quality_mil.PASSAGE)] or [[]]
    hidden, gate = [], []
    for part in parts:
        at, counts = quality_mil.word_table(part)
        mean = net.embedding[at].mean(0).mean(0) if part else np.zeros(quality_mil.DIM)
        n, size = max(len(part), 1), max(counts[:, 0].sum(), 1) if part else 1
        total = counts.sum(0) if part else np.zeros(4)
        same = sum(a == b for a, b in zip(part, part[1:]))
        stats = [total[1] / size, total[2] / size, total[3] / size, total[0] / n / 12, same / n, len(set(part)) / n, len(part) / quality_mil.PASSAGE]
        h = np.tanh(np.concatenate([mean, stats]) @ net.p["w1"] + net.p["b1"])
        hidden.append(h)
        gate.append(sum(math.tanh(a) * sigmoid(b) * c for a, b, c in zip(h @ net.p["v"], h @ net.p["u"], net.p["a"])))
    weight = [math.exp(g - max(gate)) for g in gate]
    z = sum(w * h for w, h in zip(weight, hidden)) / sum(weight)
    return float(z @ net.p["o"] + net.p["c"][0] + net.shift)
