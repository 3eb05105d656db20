"""Token groups of two tokenizers against a plain restatement with the libraries' own encodings."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from studyloom.llm import cross_align as ca
from studyloom.llm.bpe import byte_bpe

ODD = [
    "", None, " ", "  ", "\n", "\t", "a", "<|endoftext|> and <s> here </s><unk>", "tail spaces   ", "a  b   c \n\n d\t\te ", "naïve café — über", "日本語のテキスト と 英語", "🙂🙃 emoji 👩‍👩‍👧 end",
    "under▁score ▁ mark", "nul\x00byte", "don't can't we'll  I'm", "=" * 3000 + " " + "-=" * 700, "x" * 5000, "é " * 400, " nbsp　wide ", "1234567890 12 3.14", "🜁" * 200 + "́" * 50, "same text", "same text",
]


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=ca.piece_bpe())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def sides(self, text):
        """[(id, bytes)] of both sides, none where the bytes differ."""
        a = [(i, bytes(self.letter[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in self.b.encode(text or ""):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + (text or "")).encode()
        return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        a, b = self.sides(text)
        out, i, j = [], 0, 0
        while i < len(a):
            own_a, own_b, at_a, at_b = [], [], 0, 0
            while not own_a or at_a != at_b:
                if at_a <= at_b:
                    own_a.append(a[i][0])
                    at_a, i = at_a + len(a[i][1]), i + 1
                else:
                    own_b.append(b[j][0])
                    at_b, j = at_b + len(b[j][1]), j + 1
            out.append((own_a, own_b))
        assert j == len(b)
        return out


def brute(rows):
    plain = Plain()
    grouped = [plain.groups(t) for _, t in rows]
    linked = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in grouped]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = []
    for (i, _), g, links in zip(rows, grouped, linked, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()), sum(n for (x, y), n in links.items() if count[x, y] == most[x]),
            sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS shard", "'x' AS pairs", "2 AS n_a", "'y' AS groups", "3 AS `a.b`")
    return sorted(map(tuple, ca.align(spark, df.repartition(3), byte_bpe(), ca.piece_bpe(), **more).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("shard", [300, ca.SHARD])
def test_odd_texts(spark, shard):
    rows = list(enumerate(ODD)) + [(3, "repeated id"), (None, "no id")]
    assert got(spark, rows, shard=shard) == sorted(brute(rows), key=str)


def test_documents(spark, sf001):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(brute(rows), key=str)
    assert sorted(map(tuple, ca.query(spark, sf001).select(*COLUMNS).collect()), key=str) == want
    assert sum(r[3] for r in want) > 10_000


def test_empty_table_and_groups(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "two tokenizers"), (2, None)], "doc_id long, text string")
    shown = {r.doc_id: r.groups for r in ca.align(spark, df, byte_bpe(), ca.piece_bpe(), with_groups=True).collect()}
    assert shown[2] == "" and shown[1] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in Plain().groups("two tokenizers"))


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same(piece):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        n = int(rng.integers(1, 200))
        ea = np.append(np.sort(rng.choice(np.arange(1, n + 1), rng.integers(0, n), replace=False)), n + 1)
        eb = np.append(np.sort(rng.choice(np.arange(1, n + 1), rng.integers(0, n), replace=False)), n + 1)
        i, j = ca.merge_path(ea, eb, piece)
        assert i[-1] == len(ea) and j[-1] == len(eb) and (np.diff(i + j)[:-1] == piece).all()
        a, b, overlaps = ca.meetings(ea, eb, piece)
        both = np.intersect1d(ea, eb)
        assert ea[a].tolist() == eb[b].tolist() == both.tolist()
        begin_a, begin_b = np.append(0, ea[:-1]), np.append(0, eb[:-1])
        want = {(x, y) for x in range(len(ea)) for y in range(len(eb)) if begin_a[x] < eb[y] and begin_b[y] < ea[x]}
        pieces = [ca.merged(ea, eb, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
        found = [t for p in pieces for t in zip(p.overlap_a.tolist(), p.overlap_b.tolist(), strict=True)]
        assert sorted(want) == sorted(found) and len(found) == overlaps


def test_tables_are_bounded_and_reused():
    own = ca.Aligner(byte_bpe(), ca.piece_bpe(), piece=50)
    texts = [f"the same words come again number {k % 7} é".encode() for k in range(50)]
    first = next(iter(own.align(texts)))
    assert len(own.held_a.young[0]) < 30
    plain = Plain()
    assert first.n_groups.tolist() == [len(plain.groups(t.decode())) for t in texts]
