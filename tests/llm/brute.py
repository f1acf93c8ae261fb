"""Plain-Python versions of the operators' results."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    w = re.findall(SPACE_WORD, (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints: list[int], radius: int = 4) -> list[int]:
    """The first position of each one's component."""
    up = list(range(len(prints)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius) + i + 1:
            a, b = top(i), top(int(j))
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(f))]


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(text: str | None) -> list[str]:
    out = []
    for kind, pattern in [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def repeats(docs: dict[int, str | None], length: int = 50) -> dict[int, tuple[int, int, str]]:
    seen: dict[tuple, int] = {}
    words = {d: re.findall(SPACE_WORD, docs[d] or "") for d in sorted(docs)}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def license_facts(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def similar_items(text: str | None, items: dict[int, str], k: int = 5, least: float = 0.8) -> set[int]:
    """Items that some item-sized window of the text is like, by weighted shingles."""
    from collections import Counter

    w = re.findall(SPACE_WORD, (text or "").lower())
    bags = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    out = set()
    for item, t in items.items():
        v = re.findall(SPACE_WORD, t.lower())
        b = bags(v)
        for s in range(-len(v), len(w)):
            a = bags(w[max(s, 0) : max(s + len(v), 0)])
            if a and b and sum((a & b).values()) / sum((a | b).values()) >= least:
                out.add(item)
                break
    return out


def first_alike(texts: list[str | None], k: int = 5) -> list[int]:
    """The first position of each one's component of exact Jaccard similarities of 0.8 at least."""
    words = [re.findall(SPACE_WORD, (t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set() for w in words]
    first = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if first[i] != first[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((first[i], first[j]))
                first = [lo if x == hi else x for x in first]
    return first


def language_buckets(text: str, buckets: int = 1 << 16) -> list[int]:
    """The bucket of every bigram and trigram of the padded lower-case text."""
    c, m = [ord(x) for x in f" {text.lower()}  "], (1 << 32) - 1
    out = []
    for i in range(len(c) - 1):
        two = (c[i] * 0x9E3779B1 + c[i + 1] * 0x85EBCA77) & m
        for h in [two, *([(two + c[i + 2] * 0xC2B2AE3D + 0x27D4EB2F) & m] if i + 2 < len(c) else [])]:
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m
            out.append((h ^ (h >> 13)) % buckets)
    return out


def naive_bayes(labelled: list[tuple[str, str]], texts: list[str | None], alpha: float = 0.1, buckets: int = 1 << 16) -> list[tuple[str, float]]:
    """Language and posterior of each text, learned from pairs of text and language."""
    import math
    from collections import Counter

    langs = sorted({lang for _, lang in labelled})
    grams, docs = {x: Counter() for x in langs}, Counter(lang for _, lang in labelled)
    for text, lang in labelled:
        grams[lang].update(language_buckets(text))
    total = {x: sum(grams[x].values()) + alpha * buckets for x in langs}
    out = []
    for text in texts:
        if not any(ch.isalpha() for ch in text or ""):
            out.append(("und", 0.0))
            continue
        n = Counter(language_buckets(text))
        z = [math.log(docs[x] / len(labelled)) + sum(k * math.log((grams[x][b] + alpha) / total[x]) for b, k in n.items()) for x in langs]
        best = max(range(len(langs)), key=lambda k: (z[k], -k))
        out.append((langs[best], 1 / sum(math.exp(v - z[best]) for v in z)))
    return out


def penalised_loss(w: np.ndarray, bias: float, rows: list, y: np.ndarray, pairs: list, penalty: float, l2: float) -> float:
    """Mean log loss with both classes of equal weight, the l2 term, and the mean squared change of the score over the swapped pairs."""
    z = np.array([w[r].sum() + bias for r in rows])
    each = np.logaddexp(0, np.where(y > 0, -z, z))
    return float((each[y > 0].mean() + each[y == 0].mean()) / 2 + l2 / 2 * (w @ w) + (penalty * np.mean([(w[a].sum() - w[b].sum()) ** 2 for a, b in pairs]) if pairs else 0))


def penalised_fit(rows: list, y: np.ndarray, pairs: list, n: int, penalty: float, l2: float, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Plain gradient descent on ``penalised_loss``."""
    w, bias = np.zeros(n), 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(steps):
        z = np.array([w[r].sum() + bias for r in rows])
        r = (1 / (1 + np.exp(-z)) - y) * weight
        g = l2 * w
        for x, v in zip(rows, r):
            g[x] += v
        for a, b in pairs:
            d = 2 * penalty / len(pairs) * (w[a].sum() - w[b].sum())
            g[a] += d
            g[b] -= d
        w, bias = w - 0.05 * g, bias - 0.05 * r.sum()
    return w, bias


def quality_statistics(text: str) -> dict[str, float]:
    """What the labellers look at, one text at a time."""
    words = re.findall(SPACE_WORD, text)
    b = text.encode()
    kind = lambda c: "s" if c == 32 or 9 <= c <= 13 else "u" if 65 <= c <= 90 else "l" if 97 <= c <= 122 or c >= 128 else "d" if 48 <= c <= 57 else "p" if chr(c) in ".,;:?!'\"()-" else "y"
    k = [kind(c) for c in b]
    shown, n = max(sum(x != "s" for x in k), 1), max(len(words), 1)
    raw = [w.encode() for w in words]
    bare = lambda w: not any(kind(c) in "lud" for c in w) or kind(w[-1]) == "y"
    lines = [x for x in b.split(b"\n") if len(x) >= 20]
    return {
        "words": len(words), "symbols": k.count("y") / shown, "upper_case": k.count("u") / max(k.count("u") + k.count("l"), 1), "repeated_words": sum(x == y for x, y in zip(words, words[1:])) / n, "distinct_words": len(set(words)) / np.sqrt(n),
        "exclamations": sum(w.endswith(b"!") for w in raw) / n, "bare_symbols": sum(map(bare, raw)) / n, "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "sentences": sum(w[-1:] in b".!?" for w in raw) / n,
    }


def vote_posteriors(votes: list[tuple[int, ...]], rounds: int = 200) -> list[float]:
    """Expectation-maximisation document by document; votes are 0 (bad), 1 (good) or -1."""
    p = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(rounds):
        share = (sum(p) + 1) / (len(p) + 2)
        chance = lambda c, j, x, p=p: (sum(q if c else 1 - q for q, v in zip(p, votes) if v[j] == x) + 0.1) / (sum(q if c else 1 - q for q in p) + 0.3)
        table = {(c, j, x): chance(c, j, x) for c in (0, 1) for j in range(len(votes[0])) for x in (-1, 0, 1)}
        like = lambda c, v: np.prod([table[c, j, x] for j, x in enumerate(v)])
        p = [share * like(1, v) / (share * like(1, v) + (1 - share) * like(0, v)) for v in votes]
    return p


def vector_codes(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[tuple]:
    """vec_id, code, error, label_error and hash of the codebooks of rows (vec_id, vector, label), by a search of all entries."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = sorted(((i, v + [0] * (length * parts - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = nearest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]


def rule_facts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeats = len({k + d for at in windows.values() if len(at) > 1 for k in at for d in range(3)})
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)


def alignment(documents: list[tuple]) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and hash of the groups, by the libraries on whole texts and sets of offsets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from osseo.llm.bpe import byte_alphabet

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_alphabet()
    of_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, total = [], {}
    for doc_id, text in documents:
        both = ([], [])
        if text:
            both = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            if {b"".join(map(of, ids)) for of, ids in zip((of_a, of_b), both)} != {f" {text}".encode()}:
                both = ([], [])
        ends = []
        for of, ids in zip((of_a, of_b), both):
            at, here = {}, 0
            for k, i in enumerate(ids):
                at[here := here + len(of(i))] = k + 1
            ends.append(at)
        groups, links, before = [], [], (0, 0)
        for offset in sorted(ends[0].keys() & ends[1].keys()):
            after = ends[0][offset], ends[1][offset]
            parts = [ids[x:y] for ids, x, y in zip(both, before, after)]
            groups.append("|".join(",".join(map(str, p)) for p in parts))
            links.append((parts[0][-1], parts[1][-1]))
            before = after
        for x in links:
            total[x] = total.get(x, 0) + 1
        out.append((doc_id, len(both[0]), len(both[1]), len(groups), links, sha(";".join(groups)) if both[0] else ""))
    best: dict = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, x, y, n, len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), h) for d, x, y, n, links, h in out]
