import pyarrow as pa
import pytest

from sourcelake.llm import tokens


@pytest.mark.parametrize("kept", [1, 40, 400])
def test_ids_do_not_depend_on_the_pieces_that_are_kept(monkeypatch, kept):
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
    encoder = tokens.Encoder(vocabulary)
    texts = [" ".join(f"w{(i * j) % 97} common, x{i}-é{j}" for j in range(30)) for i in range(20)] + [None, "", " \n", "<|endoftext|> a"]
    for _ in range(3):
        for at in range(0, len(texts), 4):
            column = pa.array(texts[at : at + 4], pa.string())
            for row, ids in tokens.encode_column(encoder, column):
                assert ids.tolist() == encoder.tokenizer.encode(texts[at + row] or "", add_special_tokens=False).ids
    assert len(encoder.keys) == len(encoder.hits) == len(encoder.starts)
