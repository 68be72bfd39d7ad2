"""Fixed values of the text functions: word lists, patterns and tables, stated plainly."""

# German function words.
DE_FUNCTION_WORDS = tuple(
    """der die das den dem des ein eine einer eines einem einen
    er sie es wir ihr ich du mich dich uns euch sein mein dein unser euer
    dieser diese dieses jener jene jenes wer was welcher welche welches sich selbst
    mir dir ihm ihnen
    in an auf aus bei mit nach von zu zur zum im am um ins ans aufs durchs fürs
    über unter vor hinter neben zwischen durch für gegen ohne bis seit während trotz wegen
    und oder aber doch jedoch denn weil da wenn falls obwohl obgleich bevor nachdem seitdem sobald
    dass ob als wie so weder noch entweder
    ist sind war waren wird werden wurde wurden haben hat hatte hatten bin bist seid
    kann könnte muss müsste soll sollte will wolle darf dürfte lässt lassen
    nicht auch schon wohl ja nein nun dann hier dort heute immer nie nur sehr ganz viel
    mehr wenig etwas alles nichts man mal halt ebenso zwar freilich allerdings natürlich vielleicht
    derjenige diejenige dasjenige""".split()
)

# Russian function words.
RU_FUNCTION_WORDS = tuple(
    """в на с к у о от до по из за под над без для при через между перед после
    я ты он она оно мы вы они меня тебя его её нас вас их мне тебе ему ей нам вам им
    мной тобой ним ней нами вами ними мой твой наш ваш свой этот эта это эти тот та то те
    кто что который которая которое себя себе собой все всё весь вся каждый
    и а но или да же ли не ни бы если когда чтобы потому поэтому так как чем уже ещё еще тоже также
    быть есть было будет были будут был была мочь могу может можем могут мог
    должен должна должны хотеть хочу хочет хотим иметь имеет имеем имеют
    где там тут здесь сюда туда тогда теперь сейчас потом сначала очень только даже ведь вот ну лишь почти просто""".split()
)

# Words that open a subordinate clause.
CLAUSE_STARTERS = tuple(
    """weil da obwohl obgleich während bevor nachdem seitdem sobald falls wenn dass ob als
    indem wodurch wobei wonach weshalb weswegen sodass damit um
    что чтобы если когда потому поэтому поскольку хотя несмотря пока после прежде едва лишь
    раз будто словно точно ли который которая которое которые которого которой которых которым которою
    которыми которую кто кого кому кем ком чей чья чьё чьи чьего чьей чьих чьим чью чьями
    где куда откуда зачем почему сколько настолько""".split()
)

# Subordinating phrases; white space between their words is free.
CLAUSE_PHRASES = (
    "потому что", "оттого что", "так как", "в то время как", "несмотря на то что", "для того чтобы", "с тех пор как", "перед тем как", "после того как",
    "до того как", "по мере того как", "как только", "как будто", "словно бы", "то лишь", "obwohl doch", "auch wenn", "so dass",
)

# Words that mark a contrast.
CONTRAST_MARKERS = tuple("aber jedoch dennoch sondern allerdings freilich trotzdem gleichwohl hingegen andererseits indessen но однако а зато впрочем напротив же".split())

# Words that carry a line on into the next.
LINE_CARRIERS = tuple("und oder aber doch denn sondern als wie die der das den dem des ein и а но или что чтобы как где куда".split())

# Auxiliary verbs that do not count as alliterating words.
AUXILIARIES = tuple("hast hat habe haben bin bist sind seid wird werden wurde wurden kann könnte muss müsste soll sollte will darf lässt lassen tue tust tut tun geht gehst stehen steht liegt".split())

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("z.B", "u.a", "u.U", "z.T", "s.o", "s.u", "vgl", "etc", "ca", "evtl", "bzw", "Dr", "Prof", "Ing", "Fr", "Hr")

# Vowels, and the consonants that can alliterate.
VOWELS = "aeiouäöüуеыаоэяиюё"
CONSONANTS = "bcdfghjklmnpqrstvwxzбвгджзклмнпрстфхцчшщ"

# Endings for the rhyme rules.
ADJECTIVE_ENDINGS = ("ий", "ый", "ой", "ая", "ое", "ые", "их", "ых", "им", "ым", "ую", "ою")
NOUN_SUFFIXES = ("ung", "heit", "keit", "tion", "sion", "ость", "ние", "тие", "ание", "ение", "аться", "иться")
SONORANTS = "кстнлрвмпб"

# Prefixes of compounds.
DE_PREFIXES = ("be", "ge", "er", "ver", "zer", "ent", "emp", "miss", "über", "unter", "durch", "hinter", "wieder", "wider", "hinterher")
RU_PREFIXES = tuple(
    """дву двух много сверх полу анти меж обще пред после макро микро гипер гипо супер экстра ультра архи контр нео псевдо квази
    пан транс интер суб инфра аэро аква био гео нефте газо электро фото кино металло стекло железо чугуно камне древо
    серно бронзо злато серебро медно стально темно пышно быстро широко высоко длинно мало тонко прямо легко тяжело густо остро
    кудряво светло тихо ясно чисто слепо гладко коротко толсто крепко сладко богато ровно кругло бело черно красно сильно""".split()
)
EL_PREFIXES = tuple(
    """συν δια επι υπερ υπο περι απο κατα ανα παρα προ μετα αντι αρχ δωρ χρυσο αργυρ σιδηρ χαλκο λιθο εκ εξ προς
    αμφι αμφοτερο φιλο πολυ παν ομο εθνο θειο νεο πρωτο γερωντο ιππο μισο μακρο μικρο""".split()
)
# German words that are no compounds although they look like some.
DE_NO_COMPOUNDS = tuple(
    """beispielsweise veranschaulichen ausreichend außerdem insbesondere unmittelbar wahrscheinlich mittlerweile überdies jedenfalls
    notwendigerweise selbstverständlich fraglicherweise zweifellos hinsichtlich hervorragend unumgänglich verbindung verhältnis verstehen
    erklärung begriff beziehung bedeutung ergebnis verfahren verlauf versuch entscheidung erfahrung erinnerung erwartung beobachtung
    benutzung benennung gebrauch gedanke gegend gelingen gelegenheit gemälde""".split()
)

#: Letters of a word: Latin with common accents, Cyrillic, Greek, Hebrew.
LETTERS = "a-zA-ZäöüÄÖÜßáàéèíìóòúùЀ-ӿԀ-ԯͰ-Ͽἀ-῿֐-׿"

# Names that a speaker line can open with.
SPEAKERS = ("ChatGPT", "GPT", "Claude", "Gemini", "DeepSeek", "Grok", "Kimi", "GLM", "Perplexity", "User")

# What tells the kind of a chunk.
QUESTION_WORDS = ("was ", "wie ", "warum ", "welche ", "wozu ", "wer ", "wann ", "wo ", "weshalb ", "wieso ")
REFLECTION = ("ich denke", "meine einschätzung", "aus meiner sicht", "meiner meinung", "ich fühle", "mein algorithmus", "meine programmierung", "als ki", "als sprachmodell")
COMPARISON = ("im gegensatz", "während", "beide", "verglichen mit", "unterschied", "ähnlich wie", "dagegen", "im vergleich", "versus", "vs.", "anders als")

# Patterns that tell a discourse from an exegesis question.
DISCOURSE = ("vergleich", "unterschied", "gegenüberstellung", r"vs\.", "versus", "anders als", "diskutiere", "positionen", "meinungen", "konsens", "divergenz", "kontroverse", "wie sehen.*modelle", "was sagen.*systeme")
EXEGESIS = ("was ist", "was bedeutet", "was wäre", "definier", "bedeutung von", "erkläre", "erläutere", "wie funktioniert", "warum", "wieso", "weshalb", "analyse", "interpretier", "hintergrund", "kontext", "einordnung")

# Signals of literary and analytical queries.
LITERARY = tuple(
    """gedicht|übersetzung|musikalität|rhythmus|metapher|poem|poetry|translation|verse|stanza|поэзия|стих|перевод|poesia|verso|tradução|essay|essai|эссе|ensaio|gattung|genre|жанр|literarische analyse|literary analysis|литературный анализ|stilistik|style|стиль|prosa|prose|проза|definition|definiert|defines|text|texte|текст|autor|author|автор|adorno|chesterton|valéry|valery|шкловский|shklovskii|shklovsky|тынянов|tynyanov|tynianov|pessoa|celan|ayer|voltaire""".split("|")
)
ANALYTICAL = ("vergleiche", "analyse", "unterschied", "entwicklung", "compare", "analyze", "difference", "evolution", "сравни", "анализ", "различие")

# Title words of primary sources and of analyses.
PRIMARY_TITLES = ("brief", "tagebuch", "tagebuchnotiz", "notiz", "protokoll", "aufzeichnung", "manuskript", "vorlesung", "briefwechsel", "korrespondenz", "stundennotiz", "sitzungsprotokoll")
ANALYSIS_TITLES = ("analyse", "gutachten", "supervision", "handoff", "fallstudie", "interpretation", "kommentar", "kritik")

# Words that keyword extraction leaves out.
KEYWORD_STOPS = ("wie", "was", "wo", "und", "oder", "der", "die", "das", "bei", "mit", "von", "über", "ist", "sind", "jeweils", "erwähnung", "auf", "den", "dem", "sagen", "meinen")

# Words that do not count in the echo measure.
ECHO_STOPS = tuple(
    """der die das ein eine einer eines einem einen ich du er sie es wir ihr mich dich sich mir dir uns euch mein dein sein unser euer
    dieser diese dieses jener jene jenes welcher welche man irgend
    in auf mit bei zu von für an aus durch um über unter vor nach neben zwischen hinter ohne statt trotz wegen während innerhalb außerhalb
    und oder aber sondern weil dass wenn als ob damit bevor nachdem seit bis sobald solange
    bin bist ist sind war waren werde wirst wird werden habe hast hat haben hatte hatten
    nicht auch noch schon nur sehr mehr etwas alles nichts wieder immer vielleicht ja nein doch halt eben mal
    was wer wo wann warum wie woher wohin deshalb trotzdem allerdings jedoch denn nämlich
    geht gehe gehen mache machst macht machen will willst wollen möchte möchten soll sollen
    kann kannst können muss musst müssen darf dürfen brauche brauchst brauchen
    so da hier dort drin rein raus rum echt wirklich ganz total voll welches""".split()
)

# Weight, name and pattern of crisis signs, in the order in which they are added up.
CRISIS = (
    (3, "suizid", r"suizid"), (3, "selbstmord", r"selbstmord"), (3, "lebensmuede", r"lebensm[üu]d"),
    (3, "sich_etwas_antun", r"(?:sich|mir|mich)\s+(?:\w+\s+){0,3}(?:etwas|das|nichts|alles)\s+antun"),
    (3, "nicht_mehr_leben", r"nicht\s+mehr\s+leben"),
    (3, "tot_sein_wollen", r"(?:will|wollte|möchte)\s+(?:\w+\s+){0,3}(?:tot|fort|weg)\s+(?:sein|werden)"),
    (3, "tot_sein_aussage", r"(?:einfach\s+)?(?:tot|fort)\s+sein"),
    (3, "umbringen", r"(?:sich|mir|mich)\s+(?:\w+\s+){0,2}umbring"),
    (3, "umbringen_konjugiert", r"bring(?:e|st|en|t)?\s+(?:mich|sich|dich|uns)\s+um"),
    (3, "telefonseelsorge_explicit", r"telefonseelsorge|0800\s*111\s*0\s*111"),
    (2, "schluss_machen", r"schluss\s+mach(?:en|t)"), (2, "keinen_sinn_mehr", r"kein(?:en|e|er)?\s+sinn\s+(?:mehr\s+)?macht?"),
    (2, "aufgeben_leben", r"aufgeb(?:en|t)\s+(?:das\s+)?leben"), (2, "schmerzen_zufuegen", r"schmerz(?:en)?\s+(?:selbst\s+)?zufüg(?:en|t)"),
    (3, "sich_selbst_verletzen", r"(?:sich|mir|mich)\s+(?:\w+\s+){0,4}selbst\s+verletz(?:en|t|e)"),
    (2, "sich_verletzen", r"(?:sich|mir|mich)\s+(?:\w+\s+){0,4}verletz(?:en|t|e)"), (3, "ritzen", r"ritz(?:en|t|e)"),
    (2, "nicht_mehr_weiter_wissen", r"nicht\s+mehr\s+weiter(?:\s+wissen)?"),
    (2, "besseres_gehen", r"es\s+(?:w[äa]re|ist)\s+(?:besser|besseres)\s+(?:wenn\s+)?ich\s+(?:gehe|fortgehe|fortbin|verschwind)"),
    (3, "fuer_immer_weg_wollen", r"(?:will|möchte)\s+(?:\w+\s+){0,3}(?:weg|fort).{0,30}(?:für\s+immer|endgültig)"),
    (3, "fuer_immer_weg_wollen_v2", r"(?:weg|fort).{0,30}(?:für\s+immer|endgültig)"),
    (2, "einfach_weg_wollen", r"(?:einfach\s+)?will\s+(?:einfach\s+)?(?:weg|fort)"),
    (1, "tod_gedanke", r"(?:tod|tot)\s+(?:gedanke|gedanken|sehnsucht)"), (1, "verzweifelt", r"verzweifelt"), (1, "hoffnungslos", r"hoffnungslos"),
    (1, "aushalten_nicht_mehr", r"nicht\s+mehr\s+aushalt(?:en|en_k[öo]nnen|en_kann)"), (1, "halte_nicht_aus", r"halt(?:e|en)\s+(?:\w+\s+){0,3}nicht\s+(?:mehr\s+)?aus"),
    (1, "alles_sinnlos", r"alles\s+ist\s+sinnlos|sinnlos"),
)
CRISIS_THRESHOLDS = {"IFS_FIGHT": 2, "IFS_CONTROL": 3, "IFS_FEAR": 2, "NAMASTE": 2}

# German months in order.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

# Marks of a dialogue with inner parts, and the labels of the parts.
PARTS_CONTEXT = (r"\b(Stimme der Kontrolle|Kontroll-Stimme|IFS_CONTROL)\b", r"\b(Stimme des Kampfes|Kampf-Stimme|IFS_FIGHT)\b", r"\b(Stimme der Furcht|Furcht-Stimme|IFS_FEAR)\b", r"\b(Inneres Familiensystem|IFS-Resonanzraum|Resonanzraum)\b", r"\b(Manager|Exile|Firefighter)\b")
PARTS = {
    "ifs_control": (r"^\s*(Stimme der Kontrolle|Kontroll-Stimme|IFS_CONTROL)\s*:", "STIMME DER KONTROLLE"),
    "ifs_fight": (r"^\s*(Stimme des Kampfes|Kampf-Stimme|IFS_FIGHT)\s*:", "STIMME DES KAMPFES"),
    "ifs_fear": (r"^\s*(Stimme der Furcht|Furcht-Stimme|IFS_FEAR)\s*:", "STIMME DER FURCHT"),
}

# Fields of a structured answer that are no claims.
CLAIM_FIELDS = ("DOKUMENTTYP", "BEFUND", r"RHETORISCHE\s+STRATEGIE", "MOTIV", r"FUNKTIONALES\s+MOTIV", "KONSEQUENZ", r"DISKURSIVE\s+KONSEQUENZ", "FAZIT", r"METHODISCHER\s+ANSATZ", r"ZENTRALE\s+ERKENNTNIS", r"ARGUMENTATIVE\s+STRATEGIE", r"BLINDE\s+FLECKEN", "STÄRKEN")
SYNTHESIS_FIELDS = ("ENTWICKLUNGSLINIE", "KONVERGENZEN", "DIVERZENZEN", r"STRUKTURELLES\s+FAZIT")
