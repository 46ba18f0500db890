"""Remembered pieces of text in the alignment of tokenizers."""

from argusframe.llm import alignment


def test_a_piece_is_encoded_and_tested_once():
    asked = []
    memo = alignment.Memo(lambda text: asked.append(text) or ([0] if text == " a" else [1, 2]), [b" a", b" b", b"c"])
    for _ in range(3):
        ids, is_spelled = memo.ids_of([" a", " bc", " a"], " a bc a", b" a bc a")
        assert ids.tolist() == [0, 1, 2, 0] and is_spelled
    assert asked == [" a", " bc"]
    for _ in range(2):
        ids, is_spelled = memo.ids_of([" a", " zz"], " a zz", b" a zz")  # tokens that do not spell their piece out
        assert ids.tolist() == [0, 1, 2] and not is_spelled
    assert memo.ids_of([" a"], " a", b" a")[1]
