import pytest

from lumarank import config
from lumarank.__main__ import main


def test_config():
    assert config.load()["grouping"]["gap_seconds"] == 30.0
    assert config.load({"grouping": {"gap_seconds": 5}})["grouping"]["min_cosine"] == 0.9
    with pytest.raises(ValueError, match="gap_seconds.*prior_weight.*unknown tone"):
        config.load({"grouping": {"gap_seconds": -1}, "scoring": {"prior_weight": "x"}, "scene_weights": {"city": {"tone": 1}}})
    assert config.merged({"a": {"key": "secret", "n": 1}}, {"a": {"key": "***", "n": 2}}, keep="***") == {"a": {"key": "secret", "n": 2}}


def test_cli_lists_queries(capsys):
    assert main(["queries"]) == 0
    assert "rescore" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nonsense"])


def test_cli_unknown_query(capsys):
    assert main(["query", "nope", "--data", "/x"]) == 2
