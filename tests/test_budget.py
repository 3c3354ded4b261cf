import json

from gleanwork.operators import learning


def test_a_document_within_its_budget_is_written_once(monkeypatch):
    written, dumps = [], json.dumps
    monkeypatch.setattr(json, "dumps", lambda *given, **how: written.append(1) or dumps(*given, **how))
    assert learning._trimmed('{"a":[1,2]}', 900) == '{\n  "a": [\n    1,\n    2\n  ]\n}'
    assert len(written) == 1
