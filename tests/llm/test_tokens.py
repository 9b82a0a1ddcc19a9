import random

import public_tokenizers
import sentencepiece as library
from tokenizers import Tokenizer

from toolwarden.llm import sentencepiece as own
from toolwarden.llm.token_counts import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n x", "it's 's 're'll !'s a'", "a<|endoftext|>b <|endoftext|>", "x\u00a0 \ny", "漢字 😀 é ß\u0085", "w" * 3000,
       "a \u3000 b", "1234 5,6", "\x00\x1c", "▁▁x  y", "  lead", "trail   ", "don't  stop" * 50]


def texts():
    rng = random.Random(8)
    letters = list("abst'remdlv  \n\t'\".,12éüß×Ç \u00a0\u3000’漢\x1c_😀▁")
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_counts_equal_the_library(docs_df):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in token_counts(docs_df(rows).repartition(3), BYTE_BPE, limit=20, entries=50).collect()}
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20), t
    assert token_counts(docs_df([]), BYTE_BPE).count() == 0


def test_pieces_equal_the_library(docs_df):
    rows = list(enumerate(texts()))
    processor = library.SentencePieceProcessor(model_file=PIECES)
    coded = own.decode(own.encode(docs_df(rows).repartition(3), PIECES), PIECES, into="again")
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "again"]
    for r in coded.collect():
        want = processor.encode(r.text or "")
        assert r.pieces == want, r.text
        assert r.again == processor.decode(want) == (r.text or "").replace("▁", " ")
    fused = own.encode(docs_df(rows[:40]), PIECES, again="back").collect()
    assert all(r.back == processor.decode(r.pieces) and r.pieces == processor.encode(r.text or "") for r in fused)
    named = docs_df([(1, "a b")]).selectExpr("*", "'x' AS pieces", "1 AS _text")
    assert own.encode(named, PIECES).select("doc_id", "_text", "pieces").first().pieces == processor.encode("a b")


def best_score(word, scores, least):
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            s = scores.get(piece, least - own.UNKNOWN_PENALTY if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_viterbi_of_a_unigram_model():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choices("abc▁"[:3], k=rng.randint(1, 4))) for _ in range(40)} | {"a", "b", "▁"})
    scores = [-rng.random() * 10 for _ in pieces]
    model = own.Model.of(["<unk>", *pieces], [0.0, *scores], [own.UNKNOWN, *[own.NORMAL] * len(pieces)])
    table = dict(zip(pieces, scores))
    words = ["".join(rng.choices("abcx", k=rng.randint(1, 12))) for _ in range(300)]
    for word, ids in zip(words, model.encode_units(words)):
        known = [model.pieces[k] for k in ids if k]
        total = sum(table[p] for p in known)
        total += (len(word) - sum(map(len, known))) * (min(scores) - own.UNKNOWN_PENALTY)
        assert abs(total - best_score(word, table, min(scores))) < 1e-9
