import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barquarry.llm.pieces import BLANK, MODEL, UNKNOWN_PENALTY, coder, decode_pieces, encode_pieces, piece_digests

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def scores():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}


def plain_best(text, scores):
    """Plain dynamic program over the whole text, without cutting it into words."""
    unknown = min(s for s in scores.values() if s > -1e8) - UNKNOWN_PENALTY
    best = [0.0]
    for j in range(1, len(text) + 1):
        options = [best[k] + scores[text[k:j]] for k in range(max(0, j - 16), j) if text[k:j] in scores]
        if text[j - 1 : j] not in scores:
            options.append(best[j - 1] + unknown)
        best.append(max(options))
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "tokenization", " ", "  ", "\n", "é", "日本", "①", "🙂", "Straße"]) | st.text(max_size=5), max_size=8))
def test_segmentation_has_the_best_score_and_decodes(scores, parts):
    text = "".join(parts)
    own = coder(PATH)
    data = own.encode([text])[0]
    assert own.decode(data) == text.replace(BLANK, " ")
    if text:
        model = sentencepiece.SentencePieceProcessor(model_file=PATH)
        unknown = min(s for s in scores.values() if s > -1e8) - UNKNOWN_PENALTY
        ids = np.frombuffer(data, dtype="<u4").tolist()
        pieces = [model.id_to_piece(i) for i in ids]
        marked = BLANK + text.replace(" ", BLANK)
        lost = sum(c not in scores for c in marked)
        total = sum(scores[p] for i, p in zip(ids, pieces, strict=True) if not model.is_byte(i)) + lost * unknown
        assert total == pytest.approx(plain_best(marked, scores))


def test_round_trip_of_awkward_rows(awkward, no_rows):
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in decode_pieces(encode_pieces(awkward)).collect():
        assert r.text == (texts[r.doc_id] or "")
    digests = piece_digests(awkward).collect()
    assert len(digests) == awkward.count() and all(r.round_trip for r in digests)
    assert piece_digests(no_rows).count() == 0
