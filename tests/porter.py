"""The second Porter algorithm as a plain procedure, letter by letter: what the projections are held against."""

VOWELS = set("aeiouy")
DOUBLES = {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}


def region(word, start):
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def short_end(word):
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


def longest(word, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word):
    special = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
    if word in special:
        return special[word]
    if len(word) <= 2 or word in "sky news howe atlas cosmos bias andes".split():
        return word
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    w = "".join(letters)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(w, 0) if r1 is None else r1
    r2 = region(w, r1)

    def fits(suffix, r):
        return len(w) - len(suffix) >= r

    s = longest(w, ["sses", "ied", "ies", "s", "us", "ss"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in "inning outing canning herring earring proceed exceed succeed".split():
        return w.replace("Y", "y")
    s = longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s.startswith("eed"):
        if fits(s, r1):
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in DOUBLES:
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    two = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="")
    s = longest(w, two)
    if s and fits(s, r1) and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in set("cdeghkmnrt")):
        w = w[: -len(s)] + two[s]
    three = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    s = longest(w, three)
    if s and fits(s, r1) and (s != "ative" or fits(s, r2)):
        w = w[: -len(s)] + three[s]
    s = longest(w, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    if s and fits(s, r2) and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (fits("e", r2) or fits("e", r1) and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and fits("l", r2) and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")
