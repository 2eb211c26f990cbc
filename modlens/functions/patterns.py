"""Regular expressions shared by the text functions.

Every class is spelled out, so that the meaning does not depend on the regex dialect.
"""

SPACE = r" \t\n\r\f\x0B\x1C\x1D\x1E\x1F\x{85}\p{Z}"
SPACES = f"[{SPACE}]+"
PUNCT = r"[!-/:-@\[-`{-~]"
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
URL = f"(http|www)[^{SPACE}]+"
MENTION = r"@[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
LETTERS = r"^\p{L}+$"
SENTENCE_END = "[.!?]+"
SENTENCE = "[^.!?]+[.!?]*"

# Penn Treebank style separation, applied in this order: (pattern, replacement, substrings without
# which the pattern cannot match).  A comma or colon before a digit stays; a period is separated where
# a space, the end or another separated mark follows.  The look at one character comes first, so that scanning is cheap.
_MARK = r"[;@#$%&?!()\[\]{}<>\"]|[:,](?![0-9])"
TREEBANK = [
    (r"\.\.\.", " ... ", ("...",)),
    (rf"(?=[;@#$%&?!()\[\]{{}}<>\":,.])({_MARK}|(?<=[^.{SPACE}])\.(?={_MARK}|'*(?:[{SPACE}]|$)))", r" \1 ", ()),
    (r"--", " -- ", ("--",)),
    (
        rf"([^'{SPACE}])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'s|'S|'m|'M|'d|'D|')([{SPACE}]|$)",
        r"\1 \2 ",
        ("'",),
    ),
]
# Fused words that the same convention splits.
FUSED_WORDS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
FUSED = [
    (r"(?i)\b(?:(can)(not)|(gim)(me)|(gon)(na))\b", r" \1\3\5 \2\4\6 "),
    (r"(?i)\b(?:(got)(ta)|(lem)(me)|(wan)(na))\b", r" \1\3\5 \2\4\6 "),
]

VOWELS = r"aeiouy\x{e0}-\x{e6}\x{e8}-\x{ef}\x{f2}-\x{f6}\x{f9}-\x{fd}"
# A final e, ed or es that is not spoken; starts at its fixed letter, so that scanning is cheap.
SILENT = rf"e(?:(?<=[^l{VOWELS} ]e)|d(?<=[^td{VOWELS} ]ed)|s(?<=[^szxchg{VOWELS} ]es))(?= |$)"
