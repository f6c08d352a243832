"""Plain Python versions of the operators, and documents with every odd case in them."""

import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, digest string, "
          "size string, key string, label string, component string, rank string, shard string, n string")
EXTRA = ("r", "d", "s", "k", "l", "c", "a", "h", "n")


def odd_documents(seed=3):
    """Copies, near copies, repeated rows, missing and empty texts, ids out of order, long texts."""
    rnd = random.Random(seed)
    words = ["the", "of", "Alpha", "beta", "gamma.", "délta", "and", "zeta,", "eta", "x1", "日本", "to"]

    def prose(n):
        return " ".join(rnd.choice(words) + str(rnd.randrange(30)) for _ in range(n))

    base = [prose(n) for n in (3, 6, 30, 120, 250)]
    texts = []
    for _ in range(60):
        parts = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(3)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        texts.append(" ".join(parts))
    texts += [base[3], base[3], base[4], None, None, "", "", "   \n\t ", "a", "A", "!!!", "12 34",
              prose(4000), "word " * 900, "x" * 5000, "\x00\x01 b", "é" * 400, base[2].upper(),
              "Under the MIT License. " * 3, "one  two\tthree\nfour", "one two three four"]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "S3", None, ""]),
             len(t or ""), *EXTRA) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[5], rows[5], (None, base[4], None, None, None, *EXTRA),
             (None, None, None, None, None, *EXTRA)]
    return rows


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def components(rows, width=4, num=85, den=100):
    """{row number: (set size, component)}; every pair is compared."""
    sets = [shingle_set(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * den >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(rows[i][0], len(sets[i]), least.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def without_repeats(rows, length):
    """[(id, bytes, removed, spans, digest)]; every window is counted."""
    counts = Counter()
    raws = [(text or "").encode() for _, text in rows]
    for raw in raws:
        counts.update(raw[k:k + length] for k in range(len(raw) - length + 1))
    out = []
    for (doc_id, _), raw in zip(rows, raws):
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if counts[raw[k:k + length]] > 1:
                covered[k:k + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((doc_id, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrase_places(text, phrases):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
    return len(words), sorted(found)


@functools.cache
def _place(pattern):
    return re.compile(f"(?<= )(?=({pattern}) )")


def detections(text, rules):
    """Spans of all rules over the line of words, without those inside a span that comes before them."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    line = " " + " ".join(words) + " "
    found = []
    for number, rule in enumerate(rules):
        if not set(rule.required) <= set(words):
            continue
        for m in _place(rule.pattern).finditer(line):
            start = line[:m.start()].count(" ") - 1
            found.append((start, start + m[1].count(" ") + 1, rule.priority, number, rule.label))
    return sorted(
        (x[0], x[1], x[3], x[4]) for x in found
        if not any(
            y is not x and y[0] <= x[0] and y[1] >= x[1]
            and (y[2] < x[2] or y[2] == x[2] and ((y[0], y[1]) != (x[0], x[1]) or y[3] < x[3]))
            for y in found))


def _choices(pattern, every):
    """Texts that match: each choice in turn, or all choices together where `every` is set."""
    def sequence(parts):
        options = [element(op, value) for op, value in parts]
        if every:
            return ["".join(x) for x in itertools.product(*options)]
        base = [o[0] for o in options]
        return ["".join(base)] + [
            "".join([*base[:i], other, *base[i + 1:]]) for i, o in enumerate(options) for other in o[1:]]

    def element(op, value):
        name = str(op)
        if name == "LITERAL":
            return [chr(value)]
        if name == "IN":
            kinds = dict((str(o), v) for o, v in value)
            if "RANGE" in kinds:
                return [chr(kinds["RANGE"][0])]
            return [chr(v) for _, v in value]
        if name == "BRANCH":
            return [t for branch in value[1] for t in sequence(branch)]
        if name == "SUBPATTERN":
            return sequence(value[-1])
        if name == "MAX_REPEAT":
            least, most, inner = value
            return [t * n for n in dict.fromkeys((most, least)) for t in (sequence(inner) if n else [""])]
        raise ValueError(name)

    # A line of words never holds two blanks in a row.
    found = sequence(re._parser.parse(pattern))
    return list(dict.fromkeys(t.strip(" ") for t in found if "  " not in t))


def matching_texts(pattern):
    """One matching text for each alternative of a rule, and the glued spellings (gplv2, gpl2)."""
    texts = _choices(pattern, False)
    if pattern.startswith("spdx"):
        texts += _choices(pattern.replace("[cs]", "s"), True)
    return list(dict.fromkeys(texts))


def all_matching_texts(pattern):
    return _choices(pattern, True)


def chance_of_good(pattern, share, accuracy):
    good, bad = share, 1 - share
    for vote, right in zip(pattern, accuracy):
        if vote != "0":
            good *= right if vote == "2" else 1 - right
            bad *= right if vote == "1" else 1 - right
    return good / (good + bad)


def label_model(patterns, rounds=100):
    """Share of good texts and accuracy of each heuristic, by expectation and maximisation text by text."""
    patterns = [p for p in patterns if p.strip("0")]
    share, accuracy = 0.8, [0.8] * len(patterns[0])
    for _ in range(rounds):
        good = [chance_of_good(p, share, accuracy) for p in patterns]
        before, share = share, (sum(good) + 8) / (len(patterns) + 10)
        for k in range(len(accuracy)):
            right = sum(g if p[k] == "2" else 1 - g for p, g in zip(patterns, good) if p[k] != "0")
            voted = sum(p[k] != "0" for p in patterns)
            accuracy[k] = min(0.99, max(0.55, (right + 8) / (voted + 10)))
        if abs(before - share) < 1e-9:
            break
    return share, accuracy


def shape_features(text):
    """{bucket: value} of the shapes of a text's bytes."""
    others = [b for b in range(33, 127) if not chr(b).isalnum()]

    def shape(b):
        kind = 2 if chr(b).islower() or b > 127 else 3 if chr(b).isupper() else 4 if chr(b).isdigit() else 0
        return 1 if b in b" \t\n\r\x0b\x0c" else kind or (5 + others.index(b) if b in others else 0)

    raw = text.encode()
    line = [shape(b) for b in b" " + raw + b" "]
    sums = Counter()
    for a, b, c in zip(line, line[1:], line[2:]):
        sums[((a << 12 | b << 6 | c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1 / len(raw)
    words = raw.split()
    pairs = list(zip(words, words[1:]))
    sums[40503 % 4096] += sum(a == b for a, b in pairs) / len(words)
    sums[2 * 40503 % 4096] += 1 - len(set(pairs)) / max(1, len(pairs)) if len(words) >= 20 else 0
    sums[3 * 40503 % 4096] += 1
    return {k: math.sqrt(v) for k, v in sums.items() if v}


def scorer(texts, votes, share, accuracy, rounds):
    """{text: score} after so many gradient steps, weight by weight."""
    inputs = [shape_features(t) for t in texts]
    good = [chance_of_good(votes(t), share, accuracy) for t in texts]
    weights, drift, speed = Counter(), Counter(), Counter()

    def guess(x):
        return 1 / (1 + math.exp(-sum(v * weights[k] for k, v in x.items())))

    for step in range(1, rounds + 1):
        slope = Counter({k: 1e-5 * w for k, w in weights.items()})
        for x, g in zip(inputs, good):
            off = (guess(x) - g) / len(texts)
            for k, v in x.items():
                slope[k] += v * off
        for k, s in slope.items():
            drift[k] = 0.9 * drift[k] + 0.1 * s
            speed[k] = 0.99 * speed[k] + 0.01 * s * s
            weights[k] -= 0.3 * drift[k] / (1 - 0.9 ** step) / (math.sqrt(speed[k] / (1 - 0.99 ** step)) + 1e-7)
    return {t: guess(x) for t, x in zip(texts, inputs)}


def naive_bayes(taught, texts, buckets):
    """[(language, posterior)]: grams of two and three bytes, each with the two blanks before a text."""
    def grams(text):
        line = [32, 32] + [b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                           for b in text.encode()] + [32, 32]
        for i in range(len(line) - 2):
            two = line[i] << 8 | line[i + 1]
            for code in (two, two << 8 | line[i + 2] | 1 << 24):
                yield (code * 2654435761 & 0xFFFFFFFF) >> 17

    counts, seen = {}, Counter(lang for _, lang in taught)
    for text, lang in taught:
        counts.setdefault(lang, Counter()).update(grams(text))
    names = sorted(counts)
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        own = Counter(grams(text))
        logs = {}
        for lang in names:
            total = sum(counts[lang].values()) + 0.5 * buckets
            logs[lang] = math.log((seen[lang] + 1) / (len(taught) + len(names))) + sum(
                n * math.log((counts[lang][g] + 0.5) / total) for g, n in own.items())
        best = max(names, key=lambda lang: logs[lang])
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out
