import pytest

from tidewell.functions.stem import stem

PAIRS = {
    "added": "add", "adding": "add", "organic": "organic", "organically": "organic", "organize": "organiz", "organized": "organiz", "geologist": "geolog", "geologists": "geolog",
    "evening": "evening", "lateral": "lateral", "paste": "paste", "pasted": "paste", "universities": "universiti", "vying": "vie", "running": "run", "fruitlessly": "fruitless",
    "generously": "generous", "national": "nation", "communism": "communism", "walks": "walk", "cats": "cat", "computing": "comput", "skies": "sky", "dying": "die", "hopping": "hop", "hoping": "hope",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "happy": "happi", "cry": "cri", "by": "by", "say": "say", "relational": "relat", "agreed": "agre", "feed": "feed", "gas": "gas", "gaps": "gap",
}


@pytest.mark.parametrize("word", PAIRS)
def test_english(word):
    assert stem(word, "en") == PAIRS[word]


@pytest.mark.parametrize("word,language,want", [("aufeinander", "de", "aufeinand"), ("kategorischen", "de", "kategor"), ("haeuser", "de", "haeus"), ("flickorna", "sv", "flick"), ("hello", "xx", "hello"), ("lichamelijke", "nl", "licham"), ("maan", "nl", "man"), ("красивыми", "ru", "красив"), ("talossa", "fi", "talo"), ("hablando", "es", "habl"), ("mange", "fr", "mang"), ("", "en", "")])
def test_others(word, language, want):
    assert stem(word, language) == want


def test_again_is_the_same():
    assert stem(stem("running", "en"), "en") == "run"


@pytest.mark.parametrize("language", ["en", "de", "nl", "es", "fr", "it", "pt", "ro", "ca", "sv", "no", "da", "fi", "ru"])
def test_every_language_is_total(language):
    for word in ("a", "ab", "y", "aaa", "xyz", "über", "нн", "ёж", "123", "'s", "don't", "x" * 300):
        assert isinstance(stem(word, language), str)


#: Pairs of the published sample vocabularies: word and stem.
PUBLISHED = {
    "es": (
        "cheque chequ|chica chic|chicago chicag|chicana chican|chicas chic|chicharrones chicharron|chichimecas chichimec|chicle chicl|chicos chic|"
        "chihuahuense chihuahuens|torá tor|tórax torax|torcer torc|toreado tor|toreados tor|toreándolo tor|torear tor|toreara tor|torearlo tor|toreó tore|"
        "torero torer|toreros torer|torio tori|tormenta torment|tormentas torment|tornado torn|tornar torn|tornen torn|torneo torne|tornillo tornill|torno torn|"
        "toronto toront|torpedearon torped|torpeza torpez|torrencial torrencial|torrenciales torrencial|torrente torrent|torreón torreon|torres torr|"
        "torrescano torrescan|hablando habl"
    ),
    "fr": (
        "continu continu|continua continu|continuait continu|continuant continu|continuation continu|continue continu|continué continu|continuel continuel|"
        "continuelle continuel|continuellement continuel|continuelles continuel|continuels continuel|continuer continu|continuera continu|continuerait continu|"
        "continueront continu|continuez continu|continuité continu|continuons continuon|contorsions contors|contour contour|contournait contourn|"
        "contournant contourn|contourne contourn|contours contour|contractait contract|contracté contract|contractée contract|contracter contract|"
        "contractés contract|contractions contract|contradictoirement contradictoir|contradictoires contradictoir|contraindre contraindr|contraint contraint|"
        "contrainte contraint|contraintes contraint|contraire contrair|contraires contrair|contraria contrari|main main|mains main|maintenaient mainten|"
        "maintenait mainten|maintenant mainten|maintenir mainten|maintenue maintenu|maintien maintien|maintint maintint|maire mair|maires mair|mairie mair|"
        "mais mais|maison maison|maisons maison|maistre maistr|maître maîtr|maîtres maîtr|maîtresse maîtress|majesté majest|majestueuse majestu|"
        "majestueusement majestu|majestueux majestu|majeur majeur|majeure majeur|major major|majordome majordom|majorité major|majorités major|mal mal|"
        "malacca malacc|malade malad|maladie malad|maladies malad|maladive malad|mange mang"
    ),
    "it": (
        "abbandonata abbandon|abbandonato abbandon|abbandonava abbandon|abbandonerà abbandon|abbandoneranno abbandon|abbandonerò abbandon|abbandono abband|"
        "abbandonò abbandon|abbaruffato abbaruff|abbassamento abbass|abbassando abbass|abbassandola abbass|abbassar abbass|abbassare abbass|abbassarono abbass|"
        "abbassarsi abbass|abbassassero abbass|abbassato abbass|abbassi abbass|abbassò abbass|abbastanza abbast|abbatté abbatt|abbattendo abbatt|"
        "abbattere abbatt|abbattersi abbatt|abbatteva abbatt|abbattevamo abbatt|abbattimento abbatt|abbattuta abbatt|abbellita abbell|abbenché abbenc|"
        "pronto pront|pronuncerà pronunc|pronuncia pronunc|pronunciamento pronunc|pronunciarsi pronunc|pronunciato pronunc|pronunzia pronunz|"
        "pronunziano pronunz|pronunziarle pronunz|pronunzio pronunz|propaga propag|propagamento propag|propaganda propagand|propagarla propag|propagasse propag|"
        "propagata propag|propagazione propag|propaghino propaghin|propalate propal|propende prop|propensi propens|propensione propension|propini propin|"
        "propizio propiz|propone propon|proponendo propon|proponendosi propon|proponenti proponent|proponeva propon|proponga propong"
    ),
    "pt": (
        "boa boa|boainain boainain|boas boas|boassu boassu|boataria boat|boate boat|boatos boat|bob bob|boba bob|bobagem bobag|bobagens bobagens|"
        "bobalhões bobalhõ|bobear bob|bobeira bobeir|bobinho bobinh|bobs bobs|boca boc|bocadas boc|bocadinho bocadinh|bocado boc|bocaiúva bocaiúv|boçal boçal|"
        "bocarra bocarr|bode bod|bodoque bodoqu|body body|boemia boem|boêmio boêmi|bogotá bogot|boi boi|bóia bói|boiando boi|quiabo quiab|quicaram quic|"
        "quickly quickly|quieto quiet|quietos quiet|quilate quilat|quilinhos quilinh|quilométricas quilométr|quilômetro quilômetr|química químic|"
        "químicos químic|quimioterapia quimioterap|quimioterápicos quimioteráp|quinhão quinhã|quinhentos quinhent|quinta quint|quintal quintal|quintão quintã|"
        "quintessência quintessent|quintuplicou quintuplic|quinze quinz|quinzena quinzen|quiosque quiosqu"
    ),
    "de": (
        "aufeinander aufeinand|aufeinanderbiss aufeinanderbiss|aufeinanderfolge aufeinanderfolg|aufeinanderfolgen aufeinanderfolg|"
        "aufeinanderfolgend aufeinanderfolg|aufeinanderfolgende aufeinanderfolg|aufeinanderfolgenden aufeinanderfolg|aufeinanderfolgender aufeinanderfolg|"
        "aufeinanderfolgt aufeinanderfolgt|aufeinanderfolgten aufeinanderfolgt|aufeinanderschlügen aufeinanderschlug|aufenthalt aufenthalt|"
        "aufenthalten aufenthalt|aufenthaltes aufenthalt|auferlegen auferleg|auferlegt auferlegt|auferlegten auferlegt|auferstand auferstand|"
        "auferstanden auferstand|auferstehen aufersteh|aufersteht aufersteht|auferstehung aufersteh|auferstünde auferstund|auferwecken auferweck|"
        "auferweckt auferweckt|auferweckung auferweck|kategorie kategori|kategorien kategori|kategorisch kategor|kategorische kategor|kategorischen kategor|"
        "kategorischer kategor|kater kat|katerliede katerlied|katern kat|katers kat|käthchen kathch|kathedrale kathedral|kathinka kathinka|katholik kathol|"
        "katholische kathol|katholischen kathol|kattun kattun|kattunhalstücher kattunhalstuch|katz katz|katze katz|katzen katz|katzensprung katzenspr"
    ),
    "nl": (
        "lichaamsziek lichaamsziek|lichamelijk licham|lichamelijke licham|lichamelijkheden licham|lichamen licham|lichere licher|licht licht|lichte licht|"
        "lichten licht|lichtende lichtend|lichter lichter|lichters lichter|opheffen opheff|opheffende opheff|opheffing opheff|opgingen opging"
    ),
    "sv": (
        "jakt jakt|jaktbössa jaktböss|jakten jakt|jakthund jakthund|jaktkarl jaktkarl|jaktkarlar jaktkarl|jaktkarlarne jaktkarl|jaktkarlens jaktkarl|"
        "jaktlöjtnanten jaktlöjtnant|jaktlöjtnantens jaktlöjtnant|jalusi jalusi|jalusien jalusi|jalusier jalusi|jalusierna jalusi|jamaika jamaik|jamat jam|"
        "jamrande jamr|jamt jamt|jemna jemn|klo klo|kloaken kloak|klock klock|klocka klock|klockan klockan|klockor klock|klok klok|kloka klok|klokare klok|"
        "klokast klok|klokaste klok|klokhet klok|klokt klokt|kloroform kloroform|kloster klost|klostergården klostergård|klosterporten klosterport"
    ),
    "da": (
        "indtage indtag|indtagelse indtag|indtager indtag|indtages indtag|indtaget indtag|indtil indtil|indtog indtog|indtraf indtraf|indtryk indtryk|"
        "indtræde indtræd|indtræder indtræd|indtræffe indtræf|indtræffer indtræf|indtrængende indtræng|indtægt indtæg|indtægter indtæg|indtægterne indtæg|"
        "indvandre indvandr"
    ),
    "no": (
        "havnedistriktene havnedistrikt|havnedistrikter havnedistrikt|havnedistriktet havnedistrikt|havnedistriktets havnedistrikt|havnedrift havnedrift|"
        "havneeffektivitet havneeffektivit|havneeier havneei|havneeiere havneeier|havneenheter havneen|havneforbund havneforbund|havneforbundets havneforbund|"
        "havneforvaltningen havneforvaltning|havnefunksjonene havnefunksjon|opprettelse opprett|opprettelsen opprett|opprettelsens opprett"
    ),
    "ru": (
        "в в|вавиловка вавиловк|вагнера вагнер|вагон вагон|вагона вагон|вагоне вагон|вагонов вагон|вагоном вагон|вагоны вагон|важная важн|важнее важн|"
        "важнейшие важн|важнейшими важн|важничал важнича|важно важн|важного важн|важное важн|важной важн|важном важн|важному важн|важности важност|"
        "важностию важност|важность важност|важностью важност|важную важн|важны важн|важные важн|важный важн|важным важн|важных важн|вазах ваз|вазы ваз|"
        "вакса вакс|вакханка вакханк|вал вал|валандался валанда|валентина валентин|валериановых валерианов|валерию валер|валетами валет|п п|па па|пава пав|"
        "павел павел|павильон павильон|павильонам павильон|павла павл|павлиний павлин|павлиньи павлин|павлиньим павлин|павлович павлович|павловна павловн|"
        "павловне павловн|павловной павловн|павловну павловн|павловны павловн|павловцы павловц|павлыч павлыч|павлыча павлыч|пагубная пагубн|падает пада|"
        "падай пада|падал пада|падала пада|падаль падал|падать пада|падаю пада|падают пада|падающего пада|падающие пада|падеж падеж|падение паден|"
        "падением паден|паденьем паден|паденья паден|падет падет|падут падут|падчерица падчериц|падчерицы падчериц|падшая падш"
    ),
    "fi": (
        "edeltänyt edeltäny|edeltävien edeltäv|edelyttivät edelyttiv|edesmennen edesmen|edessä ede|edestakaisin edestakais|edestä ede|innostuneet innostun|"
        "talossa talo|taloissa talo"
    ),
}


@pytest.mark.parametrize("language", PUBLISHED)
def test_published_pairs(language):
    pairs = [pair.split() for pair in PUBLISHED[language].split("|")]
    assert len(pairs) > 9 and [(w, stem(w, language)) for w, _ in pairs] == [tuple(p) for p in pairs]
