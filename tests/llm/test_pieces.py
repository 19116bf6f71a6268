"""The whole vocabulary takes part in language identification."""

import public_tokenizers as P

from sievemark.llm import language_id


def test_no_piece_of_the_vocabulary_is_left_out():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin = chr(language_id.BEGIN)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    letters = {p for p in found if p.lstrip(begin).isalpha()}
    assert max(map(len, letters)) <= language_id.PIECE_CHARS
    assert language_id.n_pieces(path) == len(letters | {begin})
