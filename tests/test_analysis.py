import pytest
from pyspark.sql import functions as F

from textlode.functions.analysis import STOP_WORDS, Analyzer, analyze, positions
from textlode.functions.stem import STEMMERS, english


def tokens(spark, text, analyzer=Analyzer()):
    return analyze(spark.createDataFrame([(0, text)], "doc_id long, text string"), analyzer).first().tokens


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("don't stop-me_now!", ["don", "t", "stop", "me", "now"]),
        ("x\ty\n\nz", ["x", "\t", "y", "\n", "\n", "z"]),
        ("a b", ["a", "b"]),
        ("a\u0085b", ["a", "b"]),
        ("c\u001cd\u001fe", ["c", "d", "e"]),
        ("e　f​g", ["e", "f​g"]),
        ("‘quoted’ – dash", ["‘quoted’", "–", "dash"]),
        ("", []),
        ("  ", []),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, text) == expected


def test_filters_renumber_positions(spark):
    docs = spark.createDataFrame([(0, "The old games of an Album"), (1, "it is")], "doc_id long, text string")
    found = positions(analyze(docs, Analyzer(3, STOP_WORDS))).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in found] == [(0, "old"), (1, "games"), (2, "album")]
    assert analyze(docs, Analyzer(3, STOP_WORDS)).count() == 2


def test_stems_keep_order_and_repeats(spark):
    assert tokens(spark, "running games running", Analyzer(language="english")) == ["run", "game", "run"]
    assert tokens(spark, "", Analyzer(language="english")) == []
    with pytest.raises(ValueError):
        Analyzer(language="klingon")


@pytest.mark.parametrize(
    ("word", "stem"),
    list({
        "caresses": "caress", "flies": "fli", "ties": "tie", "gas": "gas", "this": "this", "hopping": "hop", "hoping": "hope", "luxuriating": "luxuri", "consignment": "consign", "consistency": "consist",
        "consolatory": "consolatori", "conspicuously": "conspicu", "knackeries": "knackeri", "generously": "generous", "dying": "die", "news": "news", "say": "say", "by": "by", "happy": "happi", "national": "nation",
        "bled": "bled", "falling": "fall", "controlled": "control", "agreed": "agre", "feed": "feed", "sky": "sky", "relational": "relat", "hopefulness": "hope", "adoption": "adopt", "singly": "singl", "roll": "roll",
    }.items()),
)
def test_porter2(word, stem):
    assert english(word) == stem


def test_tokens_are_the_plain_rule(spark, sf_dir):
    import re
    import string

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = str.maketrans(string.punctuation, " " * 32)
    expected = {r.doc_id: re.findall(r"\S+|\t|\n", r.text.translate(table).lower()) for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in analyze(docs, Analyzer()).collect()} == expected


def test_one_scan_of_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = positions(analyze(docs, Analyzer())).groupBy("term").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize(
    ("language", "words"),
    [
        ("german", {"aufeinander": "aufeinand", "aufeinanderfolgen": "aufeinanderfolg", "katers": "kat", "katze": "katz", "kategorischen": "kategor", "häuser": "haus", "straße": "strass", "freundlichkeit": "freundlich", "verhältnisse": "verhaltnis", "schönste": "schon"}),
        ("swedish", {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "klokhetens": "klok", "friskt": "frisk", "hopplöst": "hopplös"}),
        ("norwegian", {"havnedistriktene": "havnedistrikt", "opningen": "opning", "havnemyndighetene": "havnemynd", "oppdraget": "oppdrag"}),
        ("danish", {"undersøgelse": "undersøg", "indtagelse": "indtag", "indtog": "indtog", "underskovs": "underskov"}),
        ("french", dict(x.split(":") for x in "continuait:continu continuation:continu continuellement:continuel continuité:continu continuons:continuon contorsions:contors contradictoirement:contradictoir contraindre:contraindr contraria:contrari maintenaient:mainten maintenant:mainten maintenue:maintenu maîtresses:maîtress majestueusement:majestu majeure:majeur majorité:major maladive:malad".split())),
        ("spanish", dict(x.split(":") for x in "cheques:chequ chetumaleños:chetumaleñ chicharrones:chicharron tórax:torax toreándolo:tor torearlo:tor toreó:tore toreros:torer tornen:torn torniquete:torniquet torpedearon:torped torpeza:torpez".split())),
        ("portuguese", dict(x.split(":") for x in "boataria:boat boates:boat bobagem:bobag bobagens:bobagens bobalhões:bobalhõ bobeira:bobeir bocadas:boc bocaiúva:bocaiúv bodoque:bodoqu boemia:boem".split())),
        ("italian", dict(x.split(":") for x in "abbandonerà:abbandon abbandono:abband abbassamento:abbass abbassandola:abbass abbassarsi:abbass abbassassero:abbass abbastanza:abbast abbattesse:abbattess abbenché:abbenc pronuncerà:pronunc".split())),
        ("dutch", dict(x.split(":") for x in "lichamelijkheden:licham lichamen:licham lichtende:lichtend lichtgevoeligheid:lichtgevoel lichthoeveelheid:lichthoevel lichtjes:lichtjes opglanzingen:opglanz opgravingen:opgrav".split())),
        ("russian", dict(x.split(":") for x in "важнейшими:важн важничал:важнича важностию:важност павла:павл падаль:падал падать:пада падением:паден падет:падет падчерица:падчериц падшая:падш".split())),
        ("porter", dict(x.split(":") for x in "ponies:poni ties:ti agreed:agre conflated:conflat sized:size hopping:hop failing:fail filing:file conformabli:conform feudalism:feudal sensibiliti:sensibl formative:form replacement:replac adoption:adopt rate:rate cease:ceas controll:control".split())),
    ],
)
def test_other_stemmers(language, words):
    assert {w: STEMMERS[language](w) for w in words} == words


@pytest.mark.parametrize("language", sorted(STEMMERS))
def test_odd_words(language):
    odd = ["", "e", "'", "yy", "que", "ъ", "aé", "niss", "ß", "iii", "\t", "x" * 5000, "aei" * 2000]
    assert all(isinstance(STEMMERS[language](w), str) for w in odd)
