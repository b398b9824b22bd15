"""What a worker holds between the tasks that encode."""

from larder.llm import pieces
from larder.llm.token_count import model_path


def test_a_finished_task_leaves_the_model_only():
    path = model_path(None)
    code = pieces.encoder(path)
    texts = ["unhappily misjudged\nnewspapers  of Źródła 東京 \x00", "", "neighbourhoods 12345 zzxqv ▁▁ a", "antidisestablishment"]
    first = [code.both(t) for t in texts]
    learnt = dict(code.by.fits)
    assert learnt
    pieces.forget(path)
    assert pieces.encoder(path) is code
    assert not (len(code) or code.old or code.other or code.by.fits)
    assert [code.both(t) for t in texts] == first
    assert {k: v for k, v in learnt.items() if code.m.ids.keys() >= set(k)}.items() <= code.by.fits.items()  # kept as numbers meanwhile
    lib = pieces.model(path).lib
    assert [code.encode(t) for t in texts] == [[*lib.encode(t), lib.eos_id()] for t in texts]
    pieces.forget(path)
