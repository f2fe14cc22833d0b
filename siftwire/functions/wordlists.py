"""Word lists of the message domain, in plain form and natural order."""

LABEL_CODES = {"ham": 0, "spam": 1}
LABEL_NAMES = {0: "ham", 1: "spam"}

# Short-message abbreviations.
SLANG = {
    "u": "you", "ur": "your", "r": "are", "y": "why", "k": "okay", "ok": "okay",
    "pls": "please", "plz": "please", "thx": "thanks", "thnx": "thanks", "txt": "text",
    "msg": "message", "msgs": "messages", "b4": "before", "2day": "today",
    "2moro": "tomorrow", "2nite": "tonight", "4u": "for you", "gr8": "great",
    "l8r": "later", "l8": "late", "w8": "wait", "bf": "boyfriend", "gf": "girlfriend",
    "omg": "oh my god", "lol": "laughing out loud", "brb": "be right back",
    "btw": "by the way", "imo": "in my opinion", "tbh": "to be honest",
    "idk": "i don't know", "fyi": "for your information", "asap": "as soon as possible",
    "lmk": "let me know", "nvm": "never mind", "smh": "shaking my head",
    "gg": "good game", "fomo": "fear of missing out", "dm": "direct message",
    "rn": "right now", "fr": "for real", "ngl": "not gonna lie", "w/": "with",
    "w/o": "without", "b/c": "because", "bc": "because", "cuz": "because",
    "coz": "because", "gonna": "going to", "wanna": "want to", "gotta": "got to",
    "kinda": "kind of", "sorta": "sort of", "ya": "you", "yall": "you all",
    "aint": "is not", "dont": "do not", "doesnt": "does not", "cant": "cannot",
    "wont": "will not", "shouldnt": "should not", "wouldnt": "would not",
    "couldnt": "could not", "didnt": "did not", "hadnt": "had not", "hasnt": "has not",
    "havent": "have not", "isnt": "is not", "wasnt": "was not", "werent": "were not",
}

# Hinglish words; where both lists know a word this one wins.
HINGLISH = {
    "paisa": "money", "paise": "money", "rupaye": "rupees", "rupya": "rupee",
    "jeetiye": "win", "jeeto": "win", "jeet": "win", "inam": "prize", "inaam": "prize",
    "muft": "free", "mushkil": "difficult", "badhai": "congratulations",
    "badhiya": "excellent", "suniye": "listen", "abhi": "now", "turant": "immediately",
    "jaldi": "quickly", "call": "call", "karo": "do", "kare": "do", "karein": "do",
    "kariye": "do", "dijiye": "give", "bhejiye": "send", "bhejo": "send",
    "dhamaka": "blast", "offer": "offer", "mauka": "chance", "avsar": "opportunity",
    "sasta": "cheap", "mehnga": "expensive", "aaj": "today", "kal": "tomorrow",
    "yahan": "here", "wahan": "there", "kab": "when", "kaise": "how", "kyon": "why",
    "kyunki": "because", "lekin": "but", "aur": "and", "ya": "or", "nahi": "no",
    "haan": "yes", "accha": "good", "bura": "bad", "bahut": "very", "zyada": "more",
    "kam": "less", "sab": "all", "kuch": "some", "matlab": "meaning",
    "samjho": "understand", "dekho": "look", "batao": "tell", "chalo": "let's go",
    "ruko": "wait", "suno": "listen",
}

# Words that mark a suspicious message.
SPAM_KEYWORDS = (
    "free", "winner", "prize", "congratulations", "claim", "urgent", "limited", "offer",
    "discount", "deal", "cash", "money", "credit", "loan", "debt", "click", "subscribe",
    "unsubscribe", "opt-in", "guarantee", "risk-free", "no-obligation", "act now",
    "don't miss", "expires", "today only", "earn", "income", "profit", "investment",
    "viagra", "pharmacy", "weight loss", "diet", "nigeria", "prince", "inheritance",
    "transfer", "password", "verify", "account", "suspended", "lottery", "jackpot",
    "selected", "chosen",
)

# Negations that stay although the stop list holds some of them.
NEGATIONS = ("not", "no", "nor", "never", "neither", "nobody", "nothing")

# The public English stop list of 179 words.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them
    their theirs themselves what which who whom this that that'll these those am is are was
    were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don don't should should've now d ll m o re ve y
    ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)


def stopwords(language="english", extra=(), keep=NEGATIONS):
    """Stop list of a language plus ``extra`` words, without the words in ``keep``."""
    if language == "english":
        base = ENGLISH_STOPWORDS
    else:
        from pyspark.ml.feature import StopWordsRemover

        base = StopWordsRemover.loadDefaultStopWords(language)
    return sorted((set(base) | set(extra)) - set(keep))

# Irregular verb forms and their lemma, as "lemma: forms".
IRREGULAR_VERBS = """
be: am is are was were been being; have: has had having; do: does did done; go: goes went gone; say: said; make: made; get: got gotten;
know: knew known; think: thought; take: took taken; see: saw seen; come: came; give: gave given; find: found; tell: told; become: became;
leave: left; feel: felt; bring: brought; begin: began begun; keep: kept; hold: held; write: wrote written; stand: stood; hear: heard;
mean: meant; meet: met; run: ran running; pay: paid; sit: sat sitting; speak: spoke spoken; lead: led; grow: grew grown; lose: lost;
fall: fell fallen; send: sent; build: built; understand: understood; draw: drew drawn; break: broke broken; spend: spent; win: won winning;
buy: bought; choose: chose chosen; eat: ate eaten; teach: taught; sell: sold; catch: caught; fight: fought; drive: drove driven;
sleep: slept; wear: wore worn; steal: stole stolen; forget: forgot forgotten; ride: rode ridden; fly: flew flown flies; sing: sang sung;
swim: swam swum swimming; ring: rang rung; drink: drank drunk; sink: sank sunk; throw: threw thrown; rise: rose risen; wake: woke woken;
lie: lay lain lying; die: dying; tie: tying; stop: stopped stopping; plan: planned planning; get: getting; put: putting; cut: cutting; let: letting;
qualify: qualified; reply: replied; copy: copied; carry: carried; apply: applied; try: tried; worry: worried; verify: verified
"""
# Irregular plurals, likewise.
IRREGULAR_NOUNS = """
man: men; woman: women; child: children; person: people; foot: feet; tooth: teeth; goose: geese; mouse: mice; ox: oxen; life: lives;
wife: wives; knife: knives; leaf: leaves; half: halves; self: selves; shelf: shelves; thief: thieves; loaf: loaves; datum: data;
medium: media; criterion: criteria; phenomenon: phenomena; analysis: analyses; crisis: crises; index: indices; axis: axes; basis: bases
"""
# Regular words of message traffic that the rules may lead to, by class.
REGULAR_VERBS = """
accept account act add agree allow answer appear apply approve arrive ask award believe block call cancel carry change charge check claim
click close collect confirm connect contact continue copy cost cover create credit decide delete deliver dial download earn email enter
expect expire explain fail follow forward happen help hope include inform invite join keep last learn like link listen live load log look
love match miss move need notice offer open order pass pick place play post press print process protect provide publish push qualify raise
reach read receive register remember remove renew reply report request reserve return reward save scan select serve share show sign start
stay submit subscribe support switch talk test text thank touch transfer travel try turn unlock update upgrade use verify visit wait walk want watch wish work worry
"""
REGULAR_NOUNS = """
account address agent amount answer app area award bank bill bonus box box brand business buy call card cash change charge chance city class code
company contact cost country coupon customer date day deal delivery detail discount dollar draw email entry event fee file form friend game
gift group guarantee guest holiday home hour house idea issue item job key letter line link list loan lunch mail match meeting member message
minute mobile money month name network news night note number offer office order owner page parent party password payment phone picture place
plan point police price prize problem product promotion question rate reason record request result reward sale school score service shop site
song store story student subscription surprise survey system team test text thing ticket time tone tour train transaction trip update user
video voucher way week winner word work world year
"""


def irregular(text: str) -> list[tuple[str, str]]:
    """(form, lemma) of a list of irregular words."""
    pairs = (part.split(":") for part in text.replace("\n", " ").split(";"))
    return sorted({(form, lemma.strip()) for lemma, forms in pairs for form in forms.split()})
