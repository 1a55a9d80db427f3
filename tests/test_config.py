import pytest

from harborline.plans.config import ConfigError, Quarantine, parse

BASE = {"format": "csv", "dest_table": "t", "columns": [{"source": "a", "dest": "a", "type": "integer"}]}


def test_defaults():
    p = parse(BASE)
    assert (p.write_mode, p.retry_cap, p.stale_timeout_minutes, p.batch_size, p.source_manifest, p.columns[0].required) == ("append", 3, 30, 1000, "optional", True)


@pytest.mark.parametrize("change", [
    {"format": "xml"}, {"write_mode": "upsert"}, {"write_mode": "cdc"}, {"source_manifest": "maybe"}, {"columns": [{"source": "a", "dest": "a", "type": "decimal"}]},
    {"columns": [{"source": "a", "dest": "a", "type": "integer", "encrypt": {"algorithm": "aes-256-gcm", "key": "env:K"}}]},
    {"columns": [{"source": "a", "dest": "a", "type": "string", "encrypt": {"algorithm": "aes-256-gcm", "key": "literal"}}]},
    {"quarantine": {"enabled": True, "dir": "/q"}}, {"quarantine": {"enabled": True, "dir": "/q", "max_invalid_fraction": 2}}, {"quarantine": {"enabled": True, "max_invalid_rows": 1}},
    {"excel": {"sheet": 0}}, {"format": "excel"}, {"format": "fixed_width"},
    {"format": "fixed_width", "columns": [{"source": "a", "dest": "a", "type": "string", "start": 1, "width": 5}, {"source": "b", "dest": "b", "type": "string", "start": 5, "width": 2}]},
    {"cdc": {"keys": ["z"], "operation_column": "op", "sequence_by": "a", "operations": {"delete": ["D"]}}},
])
def test_refused(change):
    with pytest.raises(ConfigError):
        parse(BASE | change)


def test_threshold_is_strict():
    q = Quarantine("d", max_invalid_fraction=0.5, max_invalid_rows=3)
    assert not q.exceeded(2, 4) and q.exceeded(3, 4) and q.exceeded(4, 100) and not q.exceeded(3, 100) and not q.exceeded(0, 0)
