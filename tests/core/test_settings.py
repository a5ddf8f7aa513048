"""Settings from files."""

import pytest

from lattica.schema import DEFAULTS, read_settings


def test_a_file_replaces_defaults(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('window = 10\nalpha = 0.3\nwinsor = [0.05, 0.95]\n[channel_weights]\ntrade = 0.5\n')
    s = read_settings(str(f))
    assert (s.window, s.alpha, s.winsor, s.damping) == (10, 0.3, (0.05, 0.95), DEFAULTS.damping)
    assert s.channel_weights == DEFAULTS.channel_weights | {"trade": 0.5} and DEFAULTS.channel_weights["trade"] == 0.30
    j = tmp_path / "s.json"
    j.write_text('{"missing_threshold": 1, "contiguity_km": 50}')
    assert read_settings(f"file://{j}").missing_threshold == 1.0 and read_settings(str(j)).contiguity_km == 50.0
    j.write_text("")
    assert read_settings(str(j)) == DEFAULTS


@pytest.mark.parametrize("text", ['{"windw": 3}', '{"window": 2.5}', '{"window": true}', '{"alpha": 1.5}', '{"alpha": "0.4"}', '{"winsor": [0.9, 0.1]}', '{"winsor": [0.1]}', '{"channel_weights": {"rail": 1}}'])
def test_overrides_are_checked(tmp_path, text):
    f = tmp_path / "s.json"
    f.write_text(text)
    with pytest.raises((KeyError, ValueError)):
        read_settings(str(f))
