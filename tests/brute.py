"""Plain-Python answers on small inputs, to check the jobs against."""

import math
import re
from collections import Counter

from driftline import fixed_values as fv


def raw_spans(text):
    found = []
    for ordinal, (kind, pattern, group) in enumerate(fv.SENSITIVE_PATTERNS):
        for m in re.finditer(pattern, text):
            found.append((m.start(group), ordinal, m.end(group), kind))
    return sorted(found)


def kept_spans(text):
    end, kept = 0, []
    for s in raw_spans(text):
        if s[0] >= end:
            kept.append(s)
            end = s[2]
    return kept


def entropy(word):
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def redact(text):
    """Redacted text and (type, line, length, token) items."""
    kept = kept_spans(text)
    totals = Counter(s[3] for s in kept)
    seen, items, out, at = Counter(), [], "", 0
    for start, _, end, kind in kept:
        token = f"[REDACTED_{kind.upper()}_{totals[kind] - seen[kind]}]"
        seen[kind] += 1
        items.append((kind, text.count("\n", 0, start) + 1, end - start, token))
        out, at = out + text[at:start] + token, end
    out += text[at:]
    lines = out.split("\n")
    number = totals["secret"]
    for line_no, line in enumerate(lines, 1):
        for word in re.findall(fv.ENTROPY_WORD, line):
            if entropy(word) >= fv.ENTROPY_THRESHOLD:
                number += 1
                token = f"[REDACTED_SECRET_{number}]"
                items.append(("secret", line_no, len(word), token))
                out = out.replace(word, token, 1)
    return out, items


def injections(text, levels):
    found = []
    for ordinal, (_, pattern, severity) in enumerate(fv.INJECTION_PATTERNS):
        if severity in levels:
            for n, line in enumerate(text.split("\n"), 1):
                found += [(ordinal, n, m.group()) for m in re.finditer(pattern, line)]
    return found


def tokens(text):
    return re.findall(r"\b" + fv.TOKEN + r"\b", text.lower())


def fit(docs, size=fv.VOCABULARY_SIZE):
    words = [tokens(d) for d in docs]
    counts, first = Counter(), {}
    for n, doc in enumerate(words):
        for i, w in enumerate(doc):
            counts[w] += 1
            first.setdefault(w, (n, i))
    order = sorted(counts, key=lambda w: (w not in fv.TECH_TERMS, -counts[w], first[w]))[:size]
    df = Counter(w for doc in words for w in set(doc))
    return {w: math.log((len(docs) + 1) / (df[w] + 1)) + 1 for w in order}


def vector(text, idf):
    n = Counter(tokens(text))
    v = {w: n[w] * idf[w] for w in idf if n[w]}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / size for w, x in v.items()}


def cosine(a, b, idf):
    va, vb = vector(a, idf), vector(b, idf)
    return sum(va[w] * vb.get(w, 0.0) for w in va)
