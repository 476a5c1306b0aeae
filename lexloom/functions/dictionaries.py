"""Small dictionaries of our own, in the shape of the inputs the operators take."""

#: Function words dropped before n-grams; a parameter of the operator.
NGRAM_STOPWORDS = (
    "a au aux avec c ce ces cet cette d dans de des dont du elle elles en est et il ils j je l la le les leur leurs m n ne nous on ont ou où par pas plus pour qu que qui quoi s sa sans se ses son sont sous sur t tu un une vous y à être"
).split()
TOPIC_STOPWORDS = sorted({*NGRAM_STOPWORDS, *"the of and to in is was that for it with as on be at by this from are der die das und ist von zu mit sich auf für nicht el los las que con una para del".split()})
#: (ord, tag, keyword, keyword's ord).
TAGS = [(i, tag, kw, j) for i, (tag, kws) in enumerate([("#THE", ["the", "thing"]), ("#SCH", ["schen", "sch"]), ("#CION", ["cion"]), ("#EAU", ["eauxe", "eaux"]), ("#HEIT", ["heit"])]) for j, kw in enumerate(kws)]
#: The same for the older tagger: lines as they are in its file.
TAG_LINES = ["#THE,the,thing\n", "#SCH,schen,sch\n", "#CION,cion,eaux\n", "#EAU,eauxe,eaux \n", "#SC,sch,heit\n", "#HEIT,heit"]
#: (ord, id, label, keywords).
ONTOLOGY = [(0, "en", "English forms", ["the", "and", "that"]), (1, "de", "German forms", ["und", "der", "nicht"]), (2, "fr", "French forms", ["les", "une", "pour"]), (3, "none", "Never found", ["zzzz"])]
#: (canonical, variants), applied in order, so chains hold.
SYNONYMS = [("the", ["thee", "this"]), ("und", ["undt", "auf"])]
SENTIMENT = {"pathetic": -2.4, "trash": -1.9, "loser": -2.2, "good": 1.9, "the": 0.3, "and": -0.2, "une": 0.8, "der": 0.4}
LANGUAGE_WORDS = {"en": "the of and to in is was that for with".split(), "fr": "le la les de des et une est pour pas".split(), "de": "der die das und ist von zu mit sich nicht".split(), "es": "el los las que con una para del por como".split()}
