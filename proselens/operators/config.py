"""Rule configuration: the shipped defaults, the built-in fallback, validation, merging and list amendments."""

from __future__ import annotations

import copy
import json

# ---------------------------------------------------------------------------
# Word lists and limits that results depend on, in their given order.

BANNED_PHRASES = """\
it's worth noting that
it is worth noting that
make no mistake
at the end of the day
the bottom line is
a testament to
game-changer
paradigm shift
unlock the potential
double-edged sword
moved the needle
closed the loop
the mirror image of
rhymes with
the flip side of
in the realm of
navigating the complexities
in the rapidly evolving landscape
in a world where
picture this:
as we navigate
today, more than ever
in conclusion,
to summarize,
writes itself
needs no embellishment
is the move
note the framing
read this under
that's the news
watch the move
pays for itself
worth its weight
worth its weight in gold
""".splitlines()

ENGAGEMENT_BAIT = """\
nobody's talking about
everybody's talking about
no one is talking about
the conversation nobody's having
what I keep coming back to
the thing I keep coming back to
where I keep landing
here's the thing
here's what's wild
here's the real question
here's what they don't tell you
let that sink in
what most people miss
few people realise
few people realize
the uncomfortable truth
the inconvenient truth
let's be honest
i'll be blunt
let me tell you why
and here's why that matters
plot twist:
""".splitlines()

SOFT_PHRASES = """\
it's worth [verb]
it is worth [verb]
i want to be plain
i want to be clear
i want to be honest
i want to be upfront
i want to be direct
i want to be transparent
gut-check
gut check
where your [word] lives
names a way
the [word] that never bends
would land
did not land
didn't land
does not land
doesn't land
lands better
land better
would land easier
landing with
land with the
landed with
landscape
is the point
is the moment
is the tell
is the whole
the one that
the thing that
the part that
the one to
a first for
the first time in this course
for the first time in
let it sit
give it a beat
sit with that
stay on it
in one line
in a nutshell
put simply
the short version is
what it buys
what it buys you
buys you
stays yours
is yours to
remains yours
one buys
[word] buys you
lands there
lands here
lands on
lands at
lands in
land there
land here
land on the
landing point
where it lands
lands first
lands with
lands next
what comes next
and what comes next
what is coming
a named cost
a named criterion
as a named
actually lands
where [word] lands
lands squarely
it lands
worth more than
worth less than
is what separates
what separates it from
counts for more than
matters more than it
the honest answer
the honest version
the honest limit
the honest truth
the honest read
the honest case
the honest part
the honest thing
the honest move
the honest thing to do
the honest position
the honest framing
""".splitlines()

FILLER_WORDS = """\
significant
crucial
essential
robust
utilize
genuinely
honestly
straightforward
seamless
seamlessly
leverage
delve
delves
delving
tapestry
showcases
""".splitlines()

FALLBACK_BANNED_PHRASES = """\
it's worth noting that
it is worth noting that
make no mistake
at the end of the day
the bottom line is
a testament to
game-changer
paradigm shift
unlock the potential
double-edged sword
moved the needle
closed the loop
the mirror image of
rhymes with
the flip side of
in the realm of
navigating the complexities
in the rapidly evolving landscape
in a world where
picture this:
as we navigate
today, more than ever
in conclusion,
to summarize,
writes itself
needs no embellishment
""".splitlines()

FALLBACK_SOFT_PHRASES = """\
it's worth [verb]
it is worth [verb]
i want to be plain
i want to be clear
i want to be honest
i want to be upfront
i want to be direct
i want to be transparent
gut-check
gut check
where your [word] lives
names a way
the [word] that never bends
""".splitlines()

PHYSICAL_NOUNS = """\
wall walls beam beams column columns joist joists truss trusses slab slabs stud studs lintel lintels girder girders
rafter rafters member members frame frames assembly assemblies footing footings pier piers""".split()

WATCH_WORDS = {"quietly": 2, "actually": 2, "silently": 2}
FALLBACK_WATCH_WORDS = {"quietly": 2}
DASH_DENSITY_CAP = 1.0
# ---------------------------------------------------------------------------

LISTS = ("banned_phrases", "engagement_bait", "soft_phrases", "filler_words", "aggregator_domains")
SWITCHES = ("no_dashes", "load_bearing_literal_only", "flag_loaded_quietly")

SHIPPED = {
    "no_dashes": True,
    "dash_density_cap": DASH_DENSITY_CAP,
    "load_bearing_literal_only": True,
    "flag_loaded_quietly": False,
    "banned_phrases": BANNED_PHRASES,
    "engagement_bait": ENGAGEMENT_BAIT,
    "soft_phrases": SOFT_PHRASES,
    "filler_words": FILLER_WORDS,
    "watch_words": WATCH_WORDS,
    "aggregator_domains": [],
}
FALLBACK = SHIPPED | {"banned_phrases": FALLBACK_BANNED_PHRASES, "soft_phrases": FALLBACK_SOFT_PHRASES, "watch_words": FALLBACK_WATCH_WORDS}


class ConfigError(ValueError):
    """A rule set that is not valid; the command line turns it into status 2."""


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def validate(user: dict) -> None:
    """Reject wrong types, blank words, negative limits and unknown keys (keys that start with _ are comments)."""
    if not isinstance(user, dict):
        raise ConfigError("a rule set must be an object")
    word_lists = {f"{prefix}{name}" for name in LISTS for prefix in ("", "add_", "remove_")}
    for key, value in user.items():
        if key.startswith("_"):
            continue
        if key in word_lists:
            good = isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value)
        elif key in SWITCHES:
            good = isinstance(value, bool)
        elif key == "dash_density_cap":
            good = _number(value) and value >= 0
        elif key == "watch_words":
            good = isinstance(value, dict) and all(k.strip() and isinstance(n, int) and not isinstance(n, bool) and n >= 0 for k, n in value.items())
        else:
            raise ConfigError(f"unknown key {key!r}")
        if not good:
            raise ConfigError(f"{key}: {value!r} is not valid")


def resolve(user: dict | None = None, base: str = "fallback") -> dict:
    """A full rule set. Without a user's, the shipped one. A user's is laid over the base: watch words by key, other keys whole; then
    add_ entries are appended where missing and remove_ entries dropped, whose removal wins."""
    if user is None:
        return copy.deepcopy(SHIPPED)
    validate(user)
    out = copy.deepcopy({"fallback": FALLBACK, "shipped": SHIPPED}[base])
    for key in out.keys() & user.keys():
        out[key] = out[key] | user[key] if isinstance(out[key], dict) else copy.deepcopy(user[key])
    for name in LISTS:
        extra = [x for x in dict.fromkeys(user.get(f"add_{name}", [])) if x not in out[name]]
        gone = set(user.get(f"remove_{name}", []))
        out[name] = [x for x in [*out[name], *extra] if x not in gone]
    return out


def load(path: str | None = None, base: str = "fallback") -> dict:
    """The rule set in a JSON file, or the shipped one."""
    if path is None:
        return resolve()
    try:
        with open(path, encoding="utf-8") as f:
            user = json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return resolve(user, base)


# ---------------------------------------------------------------------------
# Further words and phrases of the catalog, off unless a preset is asked for.
PRESETS = {
    "fillers": {"filler_words": ["important", "key", "underscores", "essentially", "fundamentally", "ultimately"], "soft_phrases": ["in many ways", "speaks to", "it's important to note"]},
    "stock": {"soft_phrases": ["empirical anchor", "methodological foundation", "rests on", "necessary-but-invisible", "unlock the potential of"]},
    "sincerity": {"filler_words": ["truthfully", "frankly", "candidly"], "soft_phrases": ["to be honest", "in all honesty", "i'll be real with you"]},
    "idioms": {"soft_phrases": ["circle back", "didn't land", "needs sharpening", "this raises important questions about", "the landscape of"]},
}
# ---------------------------------------------------------------------------


def with_presets(cfg: dict, names) -> dict:
    """A full rule set with the lists of presets appended where missing."""
    out = copy.deepcopy(cfg)
    for name in names:
        if name not in PRESETS:
            raise ConfigError(f"unknown preset {name!r}")
        for key, words in PRESETS[name].items():
            out[key] += [w for w in words if w not in out[key]]
    return out
