"""Cross-tokenizer alignment (12): both libraries called plainly on whole texts, and groups and links counted in plain code."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tests.conftest import TABLES
from typeloom.llm import token_alignment as ta
from typeloom.llm.queries import TOKENIZERS

FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain_tokens(libraries, text):
    """``[(id, bytes)]`` of both, or nothing where the bytes are not the text's."""
    a, b = libraries
    alphabet = ta.byte_alphabet()
    first = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (first, second) if text and all(b"".join(x for _, x in s) == whole for s in (first, second)) else ([], [])


def brute(libraries, texts):
    groups = []
    for t in texts:
        ends = []
        for side in plain_tokens(libraries, t or ""):
            at, own = 0, []
            for i, x in side:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups.append([[[i for e, i in side if low < e <= high] for side in ends] for low, high in zip([0, *cuts], cuts, strict=False)])
    links = [[(a, b) for g in own for a in g[0] for b in g[1]] for own in groups]
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for own, pairs in zip(groups, links, strict=True):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in own)
        sizes = [sum(len(g[k]) for g in own) for k in (0, 1)]
        out.append((*sizes, len(own), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest() if own else ""))
    return out


ODD = [
    None, "", " ", "  ", "\n", " leading", "trailing ", "two  spaces", "tab\tand \n newline  \n\n x", "it's we'll <|endoftext|> <s> </s> <unk>", "naïve 日本語 \U0001f600\U0001f600", "under▁score", "é é ﬁ ½",
    "a" * 3000, "ab" * 500, "9" * 700, "word " * 4000, "x y   z", "\x1c \x1d", "a \x85b", "​ zero", "nul \x00 byte", "1 2 3", ".,;:!?" * 50, "same", "same", "<0x41>",
]


@pytest.mark.parametrize("options", [{}, {"broadcast_pairs": 20}, {"broadcast_pairs": 0}])
def test_odd_texts(spark, libraries, options):
    df = spark.createDataFrame([(i % 20, t, 1, "z") for i, t in enumerate(ODD)], "doc_id long, text string, a int, links string")
    got = ta.token_alignment(df, *FILES, **options).collect()
    wanted = [(i % 20, *r) for i, r in enumerate(brute(libraries, ODD))]
    assert sorted((r["doc_id"], *(r[n] for n in NAMES)) for r in got) == sorted(wanted)


def test_given_documents(spark, libraries):
    """Every document of a table, also with the memory of chunks cut short."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = docs.collect()
    wanted = {r["doc_id"]: w for r, w in zip(rows, brute(libraries, [r["text"] for r in rows]), strict=True)}
    assert sum(w[2] > 0 for w in wanted.values()) > 0.9 * len(rows)
    got = ta.token_alignment(docs, *FILES).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got} == wanted


@pytest.mark.parametrize(("held", "pack"), [(1, 40), (50, 1)])
def test_packs_and_forgotten_chunks_change_nothing(spark, libraries, monkeypatch, held, pack):
    texts = [f"the word number {i // 2} again, and the word" for i in range(30)] + ODD

    def rows():
        monkeypatch.setattr(ta, "HELD", held)
        monkeypatch.setattr(ta, "PACK", pack)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "doc_id": list(range(len(texts))), "text": texts})
        for b in ta._tokens(*FILES)([batch]):
            a, b_ = b.column("a").to_pylist()[0], b.column("b").to_pylist()[0]
            for d in b.column("texts").to_pylist()[0]:
                yield [[i for c in d["chunks"] for i in side[c]] for side in (a, b_)]

    wanted = [[[i for i, _ in side] for side in plain_tokens(libraries, t or "")] for t in texts]
    assert list(rows()) == wanted


def test_empty_table(spark):
    assert ta.token_alignment(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []


def test_known_chunks_are_no_objects_of_their_own(libraries):
    """The memory of chunks is flat: lists of each chunk's own took an executor over its memory."""
    import gc

    both = ta.Tokenizers(*FILES)
    gc.collect()
    before = len(gc.get_objects())
    both.pack([" ".join(f"w{i}" for i in range(20_000))])
    gc.collect()
    assert len(both.known) == 20_000 and len(gc.get_objects()) - before < 2_000
