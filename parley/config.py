"""Options, word lists and presets. Everything here is data; nothing touches Spark."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: stop words -------------------------------------------------------------
# The results depend on exactly these words. The cleaner and the keyword ranking use two
# different sets that share the common English words.

COMMON_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all each few
more most other some such no nor not only own same so than too very s t can will just don don't
should should've now d ll m o re ve y
"""

CLEANER_WORDS = """
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't
isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
wasn't weren weren't won won't wouldn wouldn't
also would could get got like one even really think know make want go going see thing things way
people much well back still something anything nothing everything someone anyone everyone yeah
yes ok okay
im ive id youre youve hes shes theyre weve theyve dont doesnt didnt cant wont shouldnt wouldnt
couldnt isnt arent wasnt werent hasnt havent hadnt thats whats hows whys wheres
"""

FORUM_WORDS = """
reddit sub subreddit post comment comments thread op edit update deleted removed bot mod mods
upvote upvotes downvote downvotes karma gold award link source sauce repost crosspost xpost tl dr
tldr ama eli5 iirc afaik imho imo ftfy til lol lmao rofl omg wtf smh tbh ngl idk
gt lt amp nbsp http https www com org net
just like dont didnt doesnt thats youre theyre gonna wanna gotta kinda sorta cause cuz tho
submission submitting automatically reason moderator moderators rule rules violation please
message contact questions concerns
trader cake day posts ign set
x200b x200d x2019 x2018 x201c x201d quot apos
ta bc rn af asap fyi btw irl jk nvm pls plz thx ty yw np ofc obv prob def
"""

KEYWORD_WORDS = """
would could get got like know think really even well also still way much thing things something
anything nothing people person one two first new good make made see want say said going take
come came look use used time yeah yes okay actually probably maybe right need mean sure lot back
thats dont doesnt didnt cant wont isnt im ive youre hes shes theyre wasnt deleted removed comment
edit reddit sub http https www com org amp any
"""
# --- end of the fixed word lists ----------------------------------------------------------

CLEANER_STOP_WORDS = frozenset((COMMON_WORDS + CLEANER_WORDS + FORUM_WORDS).split())
KEYWORD_STOP_WORDS = frozenset((COMMON_WORDS + KEYWORD_WORDS).split())

# Columns the report cannot do without.
REQUIRED_COLUMNS = ("subreddit", "body", "controversiality", "score")


@dataclass(frozen=True)
class CleanOptions:
    """Switches of the text cleaner and the length limits of the load job."""

    remove_urls: bool = True
    remove_mentions: bool = True
    lowercase: bool = True
    remove_stopwords: bool = True
    min_length: int = 10
    max_length: int | None = None  # no limit unless asked for
    min_tokens: int = 3
    stop_words: frozenset[str] = CLEANER_STOP_WORDS


@dataclass(frozen=True)
class Preset:
    """Size of a report: hot topics and clusters. It never limits the comments that are read."""

    top_k: int
    num_clusters: int


# Run sizes.
PRESETS = {
    "demo": Preset(5, 4),
    "medium": Preset(10, 5),
    "large": Preset(15, 8),
    "full": Preset(20, 10),
}


def preset(name: str) -> Preset:
    """The named preset; an unknown name is an error."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]
