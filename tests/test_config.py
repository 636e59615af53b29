import pytest

from parley.config import (
    CLEANER_STOP_WORDS,
    CLEANER_WORDS,
    COMMON_WORDS,
    FORUM_WORDS,
    KEYWORD_STOP_WORDS,
    KEYWORD_WORDS,
    preset,
)


def test_word_lists_have_the_known_sizes():
    common = set(COMMON_WORDS.split())
    assert len(common) == 141
    assert len(common | set(CLEANER_WORDS.split())) == 242
    assert len(set(FORUM_WORDS.split())) == 122
    assert len(set(KEYWORD_WORDS.split())) == 79
    assert len(CLEANER_STOP_WORDS) == 356
    assert len(KEYWORD_STOP_WORDS) == 220
    assert len(KEYWORD_STOP_WORDS - CLEANER_STOP_WORDS) == 24
    assert len(CLEANER_STOP_WORDS - KEYWORD_STOP_WORDS) == 160


def test_presets():
    assert (preset("large").top_k, preset("large").num_clusters) == (15, 8)
    with pytest.raises(ValueError):
        preset("no such size")
