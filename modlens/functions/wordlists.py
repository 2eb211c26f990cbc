"""Default word lists.  Every one is a parameter of the function that uses it."""

from __future__ import annotations

# The public English stop list the cleaning step must agree with.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Starter noun table for the lemma rule; pass a larger one for real corpora.
NOUNS = """
account admin animal answer article attack author bigot book box boy bus case category change child
church city class clown comment community company country day dog edit editor enemy event example
fact family fool force friend game girl government group hand history hour house idea idiot image
insult issue job joke judge knife law leader lie life line list loser man match member message
minute moderator moment moron name nation number opinion page pain paper parent party people person
place point policy post power president problem question racist reason religion reply report
restaurant result review right rule school scum sentence service side site source state story
student system talk teacher team terrorist thanks thief thing threat time topic trash troll user
victim view vote war way week wife wish woman wolf word work world writer year food glass address
""".split()

# Irregular noun plurals that no suffix rule reaches.
NOUN_EXCEPTIONS = {
    "children": "child",
    "feet": "foot",
    "geese": "goose",
    "mice": "mouse",
    "oxen": "ox",
    "teeth": "tooth",
}

# Starter valence lexicon (mean rating from -4 to 4); pass a full table for real corpora.
VALENCE = {
    "abuse": -3.2, "allowed": 0.0, "amazing": 2.8, "angry": -2.3, "awful": -2.0, "awesome": 3.1,
    "bad": -2.5, "beautiful": 2.9, "best": 3.2, "clown": -1.6, "cruel": -2.8, "dead": -3.3,
    "die": -2.9, "disgusting": -2.4, "dumb": -2.3, "enjoyed": 2.3, "evil": -3.4, "excellent": 2.7,
    "fake": -2.1, "fine": 0.8, "fool": -1.9, "friendly": 2.2, "glad": 2.0, "good": 1.9,
    "great": 3.1, "happy": 2.7, "hate": -2.7, "help": 1.7, "hope": 1.9, "horrible": -2.5,
    "hurt": -2.4, "idiot": -2.3, "insulting": -2.2, "kill": -3.7, "kind": 2.4,
    "leave": -0.2, "liar": -2.3, "like": 1.5, "loser": -2.4, "love": 3.2,
    "moron": -2.2, "nasty": -2.6, "nice": 1.8, "pathetic": -2.7, "peace": 2.5, "perfect": 2.7,
    "poor": -2.1, "scum": -2.6, "shame": -2.1, "shit": -2.6, "stupid": -2.4, "terrible": -2.1,
    "terrorist": -3.7, "terrorists": -3.1, "thank": 1.5, "thanks": 1.9, "threat": -2.4,
    "trash": -2.0, "ugly": -2.3, "welcome": 2.0, "wonderful": 2.7, "worst": -3.1,
    "worthless": -1.9, "wrong": -2.1,
}

# Words that mark an abusive comment; the deterministic score of the metric queries counts them.
ABUSE_TERMS = """
trash clown idiot scum worthless moron pathetic loser stupid disgusting
""".split()

# Fixed values of the published rule-based sentiment method (Hutto and Gilbert 2014).
BOOST = 0.293
CAPS = 0.733
NEGATION = -0.74
NORMALISER = 15.0
BOOST_UP = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping fricking frickin frigging friggin fully
fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely
quite really remarkably so substantially thoroughly totally tremendously uber unbelievably
unusually utterly very
""".split()
BOOST_DOWN = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
slightly somewhat sorta sortof sort-of
""".split()
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't
doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't
mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh
wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't
rarely seldom despite
""".split()

# Starter tag table: closed-class English words.
TAGS = {
    "DT": "a all an another any both each every no some that the these this those".split(),
    "PDT": ["half", "such"],
    "WDT": ["which", "whatever"],
    "PRP": "he her him i it me she them they us we you yourself himself herself itself".split(),
    "PRP$": "his its my our their your".split(),
    "WP": ["what", "who", "whom"],
    "WP$": ["whose"],
    "IN": (
        "about above after against as at because before below between by during for from if in "
        "into like of off on over per since through under until upon while with without"
    ).split(),
    "TO": ["to"],
    "CC": "and but nor or yet".split(),
    "MD": "can could may might must shall should will would".split(),
    "VB": ["be", "do", "go", "have"],
    "VBP": ["am", "are"],
    "VBZ": ["does", "has", "is"],
    "VBD": ["did", "had", "was", "were"],
    "VBN": ["been"],
    "RB": "again here never not now so then there too very".split(),
    "UH": "ah hello hey hi oh ok okay please wow yeah yes".split(),
}

# Tag to category, as the part-of-speech shares are defined.
TAG_CATEGORIES = {
    "noun": ["NN", "NNS", "NNP", "NNPS"],
    "verb": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"],
    "adj": ["JJ", "JJR", "JJS"],
    "adv": ["RB", "RBR", "RBS"],
    "pron": ["PRP", "PRP$", "WP", "WP$"],
    "prep": ["IN"],
    "conj": ["CC"],
    "det": ["DT", "PDT", "WDT"],
    "interj": ["UH"],
}
