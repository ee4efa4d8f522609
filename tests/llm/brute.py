"""Plain one-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def remove_repeats(docs: list[tuple[int, str]], length: int, unit: str) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: (n, removed, maximal runs, sha256 of what is kept)."""
    first: dict = {}
    out = {}
    for doc, text in sorted(docs):
        data = text.encode()
        items = data if unit == "byte" else data.split()
        gone = np.zeros(len(items) + 1, bool)
        for i in range(len(items) - length + 1):
            w = items[i : i + length] if unit == "byte" else tuple(items[i : i + length])
            if w in first:
                gone[i : i + length] = True
            else:
                first[w] = doc
        gone[len(items)] = False
        runs = int(((gone[1:] == 0) & (gone[:-1] == 1)).sum())
        keep = [items[i : i + 1] if unit == "byte" else items[i] for i in range(len(items)) if not gone[i]]
        out[doc] = (len(items), int(gone.sum()), runs, sha((b"" if unit == "byte" else b" ").join(keep)))
    return out


def simhash(text: str, k: int = 4) -> int:
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids: list[int], prints: list[int], distance: int = 4) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(list(zip(ids, prints)), 2):
        if (x ^ y).bit_count() <= distance:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeat_words(ws: list[str]) -> int:
    seen: dict = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    ws = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat_words(ws),
    )


ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base_secrets(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def _byte_letters() -> dict[str, int]:
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def alignments(docs: dict[int, str | None], a_path: str, b_path: str) -> dict[int, tuple]:
    """doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by the libraries and by loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    letters = _byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    groups: dict[int, list] = {}
    for doc, text in docs.items():
        groups[doc] = []
        data = b" " + (text or "").encode()
        a, b = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        if not text or b"".join(map(a_bytes, a)) != data or b"".join(map(b_bytes, b)) != data:
            continue
        a_end, b_end = np.cumsum([len(a_bytes(i)) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
        cuts = set(a_end.tolist()) & set(b_end.tolist())
        left, right = iter(zip(a, a_end)), iter(zip(b, b_end))
        for cut in sorted(cuts):
            sides = []
            for side in (left, right):
                held = []
                while not held or held[-1][1] < cut:
                    held.append(next(side))
                sides.append([i for i, _ in held])
            groups[doc].append(tuple(sides))
    holders: dict = {}
    for doc, gs in groups.items():
        for pair in {(x, y) for g in gs for x in g[0] for y in g[1]}:
            holders[pair] = holders.get(pair, 0) + 1
    top: dict = {}
    for (x, _), n in holders.items():
        top[x] = max(top.get(x, 0), n)
    out = {}
    for doc, gs in groups.items():
        links = [(x, y) for g in gs for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
        out[doc] = (
            sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links),
            sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links), text,
        )
    return out


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item_id, rank, doc_id, score) of each item row by scoring every document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = [(doc, terms(text)) for doc, text in docs]
    held = [(doc, ts) for doc, ts in held if ts]
    df = {t: sum(t in kinds for kinds in [set(ts) for _, ts in held]) for t in {t for _, x in items for t in terms(x)}}
    n_docs, n_terms = len(held), sum(len(ts) for _, ts in held)
    out = []
    for item, text in items:
        found = []
        for doc, ts in held:
            m, score = 10 + 90 * len(ts) * n_docs // n_terms, 0
            for t in set(terms(text)) & set(ts):
                tf = ts.count(t)
                score += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(found[:k])]
    return out
