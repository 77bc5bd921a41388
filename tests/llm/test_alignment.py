"""Cross-tokenizer alignment against the definition, token by token."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tallmat.llm import alignment
from tallmat.llm.tokens import tokenizer_path

COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def byte_alphabet():
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_hand(rows):
    a_side = Tokenizer.from_file(tokenizer_path(alignment.TOKENIZER_A))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.TOKENIZER_B))
    alphabet = byte_alphabet()

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    found, count = [], Counter()
    for doc, text in rows:
        if doc is None:
            continue
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [piece(i) for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() if s else [] for s in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        of_a, of_b = defaultdict(list), defaultdict(list)
        for ids, ends, of in ((a, ends_a, of_a), (b, ends_b, of_b)):
            for i, e in zip(ids, ends):
                of[bisect_left(cuts, e)].append(str(i))
        groups = [",".join(of_a[g]) + "|" + ",".join(of_b[g]) for g in range(len(cuts))]
        links, q = [], 0
        for i, e, x in zip(a, ends_a, bytes_a):
            while q and ends_b[q - 1] > e - len(x):
                q -= 1
            while q < len(b) and ends_b[q] - len(bytes_b[q]) < e:
                if ends_b[q] > e - len(x):
                    links.append((i, b[q]))
                q += 1
        count.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((doc, len(a), len(b), len(groups), links, digest))
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(
        (doc, n_a, n_b, n_g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest)
        for doc, n_a, n_b, n_g, links, digest in found
    )


def statistics(docs):
    packed = alignment.pack_links(docs)
    size_b = len(alignment.piece_tokens(alignment.piece_model(tokenizer_path(alignment.TOKENIZER_B))))
    counts = alignment.pair_counts(packed, size_b)
    return sorted(tuple(r[c] for c in COLUMNS) for r in alignment.link_statistics(packed, counts).collect())


ODD = [
    (900, "  two  spaces   and\ttabs\r\nlines\n\n"), (901, "<s> </s> <unk> <|endoftext|>"), (902, "▁marked ▁ text"),
    (903, "naïve \U0001f600\U0001f600 中文字 क्ष x́"), (904, "ﬁ ½ ① 　 wide"), (905, " "), (906, "\x00 nul \x7f"),
    (None, "no number"), (907, "12345 6789 3.14159"), (908, "y" * 5000 + " " + "-" * 700),
]


def test_alignment(sample, sample_rows, monkeypatch):
    rows = sample_rows + ODD
    docs = sample.sparkSession.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    want = by_hand(rows)
    assert statistics(docs) == want
    assert sum(w[1] > 0 for w in want) > 0.5 * len(want) and any(w[1] == 0 for w in want)
    # many small slices give the same
    monkeypatch.setattr(alignment, "SLICE_TOKENS", 3000)
    monkeypatch.setattr(alignment, "SLICE_TEXT", 5000)
    assert statistics(docs) == want


def test_groups_give_back_the_tokens(sample):
    for r in alignment.align(sample).collect():
        assert sum(r.group_a) == len(r.a) and sum(r.group_b) == len(r.b)
        assert len(r.group_a) == len(r.group_b) and 0 not in r.group_a and 0 not in r.group_b


def test_overlaps():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        cuts = [np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 20)])) for _ in range(2)]
        a, b = (np.diff(c) for c in cuts)
        i, j = alignment.overlaps(a, b)
        ends_a, ends_b = np.cumsum(a), np.cumsum(b)
        want = [
            (p, q) for p in range(len(a)) for q in range(len(b)) if max(ends_a[p] - a[p], ends_b[q] - b[q]) < min(ends_a[p], ends_b[q])
        ]
        assert list(zip(i.tolist(), j.tolist())) == want
        group_a, group_b = alignment.coalesce(a, b)
        both = np.intersect1d(ends_a, ends_b)
        assert group_a.tolist() == np.searchsorted(both, ends_a).tolist() and group_b.tolist() == np.searchsorted(both, ends_b).tolist()


def test_alignment_odd_tables(odd, odd_rows, empty):
    assert statistics(empty) == []
    assert statistics(odd) == by_hand(odd_rows)
