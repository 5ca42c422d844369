import json

import pytest

from proselens.operators import config


def test_sizes():
    c = config.resolve()
    assert [len(c[k]) for k in ("banned_phrases", "engagement_bait", "soft_phrases", "filler_words", "watch_words")] == [34, 22, 93, 16, 3]
    f = config.resolve({})
    assert [len(f[k]) for k in ("banned_phrases", "engagement_bait", "soft_phrases", "filler_words", "watch_words")] == [26, 22, 13, 16, 1]


def test_merge_and_amend():
    c = config.resolve({"watch_words": {"live": 5}, "add_banned_phrases": ["circle back"], "remove_banned_phrases": ["game-changer"]})
    assert c["watch_words"] == {"quietly": 2, "live": 5}
    assert "circle back" in c["banned_phrases"] and "game-changer" not in c["banned_phrases"]
    assert not [k for k in c if k.startswith(("add_", "remove_"))]
    assert "game-changer" in config.resolve()["banned_phrases"]
    both = config.resolve({"add_filler_words": ["x"], "remove_filler_words": ["x"]})
    assert "x" not in both["filler_words"]
    assert len(config.resolve({"_note": 1}, base="shipped")["soft_phrases"]) == 93


@pytest.mark.parametrize("bad", [{"banned_phrases": "not a list"}, {"no_dashes": "false"}, {"no_dash": True}, {"watch_words": {"x": -1}}, {"watch_words": {"x": True}}, {"add_banned_phrases": [""]},
                                 {"watch_words": {"": 1}}, {"dash_density_cap": True}, {"dash_density_cap": -1}, []])
def test_rejected(bad):
    with pytest.raises(config.ConfigError):
        config.resolve(bad)


def test_load(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"no_dashes": False}))
    assert config.load(str(p))["no_dashes"] is False
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"))


def test_defaults_are_not_shared():
    config.resolve()["banned_phrases"].append("x")
    config.resolve({})["watch_words"]["x"] = 1
    assert "x" not in config.resolve()["banned_phrases"] and "x" not in config.resolve({})["watch_words"]
