"""Judges a mined template by general features of its words, in time linear in its length.

No phrase is looked for. Words are put into a few classes of a small general lexicon (what can fail,
how it fails, what a reader is asked to do, what a notice about scripts is about, what filler calls
itself), by stem and in eight languages. A template speaks as a message if its classes make one of
the frames in ``_core``; it *is* a message only if most of its words that aren't function words belong
to that lexicon, since a report that mentions an error has words of its own. Filler without meaning
is known by its shape: keyboard runs, repetition, and sentences of Latin endings without one function
word of a living language.

Verdicts: JUNK, NEUTRAL (title, furniture), UNSURE (the documents it stands in decide), CONTENT.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

VALUE = "<*>"
WILD = "<?>"
#: UNSURE is settled by propagation.
NEUTRAL, JUNK, CONTENT, UNSURE = 0, 1, 2, 3
#: Share of a template's own words that must be words of messages: for JUNK, and for UNSURE.
SURE_COVER, UNSURE_COVER = 0.6, 0.35

#: Small general lexicon. Stems, a word belongs to a class if it begins with one; ``=`` ends a whole word. Languages: en, de, fr, es, pt, it, nl, ru.
FAULT, NEG, STATE, THING, ASK, LATER, YOU, TECH, ACT, SAMPLE, FILL, HERE, PART, NARRATED, MANNER = (1 << i for i in range(15))
LEXICON = {
    FAULT: (
        "error fail fault denied denies forbid unauthor unavailab inaccessib expire invalid crash timeout timed= refus unreach offline maintenance interrupt reject unsupported gone= missing broke wrong= "
        "exception abort overload exceed oops whoops uh-oh sorry= corrupt malform mismatch conflict deleted removed moved withdrawn retired serviced repaired down= reset= traceback fatal critical undefined "
        "bad= too= ended= lost= stale= discontinued suspended blocked inactive lapsed problem trouble snag issue unexpected "
        "fehler fehlgeschlagen verweigert abgelaufen abgelehnt unerreichbar wartung gesperrt gelöscht verschoben ungültig abgebrochen gescheitert störung überlast "
        "erreur échec échou refusé interdit expiré indisponible introuvable inexist supprim déplac invalide panne dépass désol "
        "fallo falló errores denegad caducad expirad prohibid inválid rechazad eliminad interrumpid "
        "erro= erros= falha falhou negado indispon inválid proibid removid "
        "errore errori negato scadut vietato fallit rifiutat rimoss guasto "
        "fout fouten geweigerd verlopen verwijderd storing mislukt verboden "
        "ошибк недоступ запрещ истек отказ сбой удален неверн"
    ),
    NEG: (
        "not= no= cannot= can't= couldn't= doesn't= don't= isn't= aren't= wasn't= won't= hasn't= haven't= unable= never= nothing= without= neither= lack= lacks= "
        "nicht= kein nie= ohne= ne= n' pas= aucun impossible= sans= ningun ningún nada= sin= não= nao= nenhum sem= non= nessun impossibile= senza= niet= geen= zonder= не= нет= нельзя= без="
    ),
    STATE: (
        "exist found= find= avail load open reach display show= shown= connect respon complet process retriev permi allow access support result answer deliver render drawn= draw= fetch locat view run= runs= play work "
        "valid match available longer sehen= nutzen= ver= voir= vedere= "
        "establec podido estável conex gefunden verfügbar erreich laden= geladen öffnen anzeig angezeigt existier berecht erlaub antwort "
        "trouv disponib exist charg ouvr affich accéd autoris encontr carg abrir= mostrar= acced carreg exib trovat esist caric aprir "
        "gevonden bestaat beschikbaar geladen toegang найд существу доступ загру отобра"
    ),
    THING: (
        "page pages= site= website web file files= link links= address url server connection request session document resource account login log-in sign-in token database service services= host gateway content record access permission "
        "right= rights= article item application app= apps= peer network system folder directory feed console upstream backend proxy machine device socket certificate domain query password username user= operation action "
        "chart map= image video= form= module plugin status= code= id= ref= reference= http https port= socket method route endpoint object key= argument variable index= line= header queue stack trace memory disk time= limit rate= entry room= "
        "report= brief= konsole consola "
        "seite datei verbindung anfrage sitzung anmeldung dienst zugriff inhalt rechte= adresse anwendung konto bericht= server "
        "fichier connexion requête serveur accès contenu lien droits= compte "
        "página pagina archivo conexión solicitud sesión servidor acceso contenido permiso enlace sitio recurso cuenta "
        "arquivo conexão sessão conteúdo acesso solicitação connessione sessione contenuto accesso richiesta sito "
        "bestand verbinding sessie toegang pagina inhoud страниц файл сервер соединени сесси запрос сайт приложени"
    ),
    ASK: (
        "please= try= trying= tried= retry reload refresh check= contact return= wait= sign= log= back= again= click= tap= press= go= come= waiting= slow= start= restart= reconnect authenticate re-enter follow= visit= "
        "looking= look= requested request= ask= asked= asking= help= support= administrator use= choose= select= tell= hold= stop= "
        "bitte= versuch prüf laden= melden= kontakt warten= erneut= neu= klick "
        "veuillez= réessay vérifi recharg reconnect contact patient connectez "
        "inténte intente vuelva verifi recargue póngase favor= espere= inicie contacte "
        "tente= tentar= recarregue aguarde atualize acesse riprov ricaric attend verific aggiorn contatt accedi "
        "probeer opnieuw= ververs neem= попробу повтор пожалуйста= обнов обратит подожд войдите"
    ),
    LATER: (
        "later= soon= moment moments= minute minutes= second seconds= shortly= again= temporar currently= right= now= back= hour hours= until= while= few= yet= often= many= tomorrow coming= "
        "später= gleich= kürze= bald= moment= vorübergehend derzeit= augenblick zurzeit= demnächst= in-kürze "
        "tard= bientôt instant moment provisoir actuellement prochain venir= "
        "tarde= pronto= momento minutos próximamente actualmente breve= instantes temporal "
        "mais= logo= ora= fora= ar= poi= tardi= presto= straks binnenkort tijdelijk позже= скоро= минут времен сейчас="
    ),
    YOU: (
        "you= your= yours= you're= you've= we= we're= we'll= we've= our= us= i= sie= ihr ihnen= wir= uns= vous= votre= vos= nous= notre= usted= su= sus= tu= tus= nosotros= você seu= sua= nós= lei= suo= sua= noi= u= uw= wij= вы= ваш вас= мы="
    ),
    TECH: (
        "javascript js= script scripts= scripting cookie browser captcha robot human bot= bots= extension adblock ad-block plugin client clients= client-side add-on webgl "
        "skript navigateur navegador script robot humain humano browser cookie скрипт браузер куки робот javascript"
    ),
    ACT: (
        "enabl allow accept turn= turned= turning= switch activat requir need disabl block unblock support old= older= newer= outdated obsolet update upgrad verif check confirm prove without= off= on= only= must= muss= müssen= may= works= rely relies runs= "
        "recommend consent modern permit "
        "aktivier einschalt eingeschaltet schalten ausgeschaltet deaktivier erlaub benötig braucht brauchen erforderlich zulass aktualisier veraltet nur= funktioniert bestätig "
        "activ autoris nécessit exige désactiv besoin accept requis fonctionne bloqu mettre= jour= confirm "
        "habilit permit requier necesit desactiv acept activ bloque funciona actualic ative requer precisa aceite abilit attiv richied accett disattiv "
        "inschakel schakel nodig toestaan включ разреш требу отключ примите подтверд"
    ),
    SAMPLE: (
        "placeholder dummy= lorem= ipsum= filler= sample= example= todo= fixme= tbd= tba= tbc= stand-in mock= boilerplate= blank= empty= intentionally deliberately construction= untitled draft= template= "
        "platzhalter blindtext mustertext beispiel fülltext muster leer= entwurf "
        "remplissage exemple= fictif factice démonstration vide= relleno ejemplo prueba vacío vacio exemplo preenchimento vazio esempio riempitivo segnaposto vuoto voorbeeld leeg opvul "
        "заполнитель пример рыба= образец"
    ),
    FILL: (
        "replace replac overwrite overwritten delete= remove= swap= fill= type= paste= write= written= add= added= insert enter= put= place= placed= describe= supplied supply provide appear= appears= goes= belongs= follow= follows= come= comes= stand= announced change= changed= "
        "finish edit= keep= done= delivered published publish "
        "ersetz einfüg eintrag ergänz lösch folgt= kommt= steht= entsteht= erscheint= schreib= "
        "remplac insér compléte compléter ajout placé supprimer= rédig écri viendra= apparaîtra= sustitu reemplaz insert rellen añad escrib irá= aparecerá vendrá cambiar= borrar= "
        "substitu inserir= preench escrev sostitu inseri scriv compil vervang invoeg vul= замен встав заполн появ будет="
    ),
    HERE: "here= below= above= this= area= field= box= hier= ici= aquí aqui= acá= qui= здесь= тут= diese dieser= dieses= diesen= cette= ce= este= esta= esto= questo= questa= deze= dit= этот эту= these= ",
    PART: (
        "text= texts= paragraph heading title content copy= wording body= section summary overview description subtitle headline caption intro introduction chapter block= column= notes= note= story part= figure charts= names= numbers= list= outline abstract= details= product= main= short= simple= "
        "text absatz überschrift titel inhalt abschnitt zusammenfassung einleitung bericht "
        "texte paragraphe titre contenu résumé section texto párrafo título contenido resumen parágrafo resumo testo paragrafo titolo tekst alinea titel inhoud текст абзац заголов содержан описан"
    ),
    NARRATED: (
        "yesterday noon= night nights= morning evening week weeks= month monday tuesday wednesday thursday friday saturday sunday team crew shift they= he= she= his= her= their= them= who= whose= because= after= since= therefore= then= "
        "gestern nacht= morgens team danach= weil= deshalb= hier= matin soir équipe parce= puis= ensuite= ayer noche mañana equipo porque después ieri notte squadra perché gisteren ploeg вчера потом команд"
    ),
    MANNER: "internal general unknown= some= any= more= most= going= went= being= been= happen occur aufgetreten survenu producid interner interne interno something= nada algo= etwas quelque qualcosa iets что-то anything= everything= valid= different= another= other= full= several= next= previous= old= new= unexpected= home= inconvenience apolog looks= ocorreu ocurrid inesperad inactivity logged= date= reason=  seems= appear= ",
}
#: Function words; they neither make nor unmake a message.
FUNCTION_WORDS = frozenset(
    "the a an and or of to in on at by for from with as is are was were be been being it its it's that's there this that these those if but so do does did has have had will would can could may might must shall should than just also into over out up about your you we our get got gets give gave behind before between under through see saw came still "
    "der die das den dem des ein eine einen einem einer und oder von zu zum zur im in am an auf bei für mit aus ist sind war waren wird werden wurde wurden hat haben kann können es sie er wir dass wenn um vor nach noch nur über als auch sich dann sobald vor sein "
    "le la les l un une des du de d et ou à au aux en dans par pour sur avec est sont était été être a ont avait sera il elle on que qui se s y c'est cela si mais plus ce cette avant "
    "el los las una unos unas del al y o en por para con es son fue ha han había será se lo que si pero más como antes "
    "o os as um uma do da dos das no na nos nas em por para com é são foi ser será que se mas ao "
    "il lo gli i un uno della dello dei degli nel nella con su per è sono stato stata che se ma non "
    "de het een en of van te in op bij voor met uit is zijn was werd wordt heeft kan dat die als maar om "
    "и в во на с со к по из у о об от для что это как если но же бы мы он она они был была было были".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MASKS = re.compile(r"<[*?]>")
_END = re.compile(r"[.!?。।؟…][\"'”)»]*$")
_RULES = re.compile(r"[|·›»©•→]|\s{2,}")
_LOGGED = re.compile(r"(?:^<[*?]>|^\W*\w+=<[*?]>).*?\b(?:ERROR|WARN|WARNING|INFO|DEBUG|NOTICE|FATAL)\b|\b\w++=<[*?]>[^=]*+\b\w++=<[*?]>")
_LATIN_END = re.compile(r"(?:um|us|is|it|at|et|ur|or|ae|am|em|as|os|es|en|er|ex|unt|int|ant|ent|il|a|o|i|e)$")
_LETTERS = re.compile(r"[a-z]+$")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "abcdefgh", "poiuytrewq", "lkjhgfdsa")
_NONCE = frozenset("foo bar baz qux quux corge test dummy blah bla lala xxx xyz code0 quote0 addr0".split())  # programmers' nonsense words
_CLASSIC = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua".split())  # the customary filler passage


FUTURE = frozenset("will wird werden sera seront será serán sarà zal будет будут".split())


def _stems() -> tuple[dict[str, int], dict[str, int], int]:
    whole: dict[str, int] = {}
    begun: dict[str, int] = {}
    for kind, stems in LEXICON.items():
        for s in stems.split():
            at = whole if s.endswith("=") else begun
            at[s.rstrip("=")] = at.get(s.rstrip("="), 0) | kind
    return whole, begun, max(map(len, begun))


_WHOLE, _BEGUN, _LONGEST = _stems()


@lru_cache(maxsize=200_000)
def kinds(word: str) -> int:
    """The lexicon classes of a lower-case word, as bits; the parts of a hyphenated word count together."""
    bits = _WHOLE.get(word, 0)
    for n in range(2, min(len(word), _LONGEST) + 1):
        bits |= _BEGUN.get(word[:n], 0)
    if not bits and "-" in word:
        for part in word.split("-"):
            bits |= kinds(part)
    if not bits and word.endswith("n't"):
        bits = NEG
    if not bits and word.endswith(("error", "exception")):
        bits = FAULT  # names of errors in programs
    if "'" in word and not bits & ~NEG:
        head, _, tail = word.partition("'")
        bits |= kinds(tail) if len(head) <= 2 else kinds(head)
    return bits


@lru_cache(maxsize=200_000)
def _nonce(word: str) -> bool:
    """A word typed for its own sake: a keyboard or alphabet run, one pattern repeated, a nonsense word."""
    if word in _NONCE:
        return True
    if len(word) >= 3 and (len(set(word)) == 1 or any(word in row for row in _ROWS)):
        return True
    for n in (1, 2, 3):
        if len(word) >= 2 * n + (n == 1) and len(word) % n == 0 and word == word[:n] * (len(word) // n):
            return True
    return len(word) >= 8 and len(word) % 4 == 0 and word[:4] in _ROWS[1] and word == word[:4] * (len(word) // 4)


def _latin(words: list[str]) -> bool:
    """Words that read like Latin and have no function word of a living language among them, longer than one letter."""
    plain = [w for w in words if _LETTERS.match(w)]
    if len(plain) < 4 or len(plain) < 0.9 * len(words):
        return False
    classic = sum(w in _CLASSIC for w in plain)
    if classic >= 0.5 * len(plain):
        return True
    long = [w for w in plain if len(w) > 3]
    ends = sum(_LATIN_END.search(w) is not None for w in long)
    living = sum(len(w) > 1 and w in FUNCTION_WORDS and w not in ("et", "in", "a", "ex", "per", "si", "sit", "do", "ad", "est", "ut", "sed", "non", "qui") for w in plain)
    known = sum(kinds(w) != 0 and w not in _CLASSIC for w in plain)
    return bool(long) and ends >= 0.85 * len(long) and living == 0 and known <= 0.25 * len(plain)


def _meaningless(words: list[str]) -> bool:
    if len(words) >= 2 and sum(map(_nonce, words)) >= 0.6 * len(words):
        return True
    return _latin(words)


def word_kinds(token: str) -> int:
    """The classes of the word in a token of a template, 0 if there is none."""
    found = _WORD.search(token)
    return kinds(found.group().lower().replace("’", "'")) if found else 0


def _core(bits: int, words: list[str], known: int, other: float, ended: bool) -> bool:
    """Whether classes make the frame of an error, a request after one, a notice or filler."""
    has = lambda *kinds_: all(bits & k for k in kinds_)
    return (
        bits & FAULT != 0
        or has(NEG, STATE) and (bits & (THING | YOU | TECH | LATER) != 0 or len(words) <= 6)
        or has(NEG, THING)
        or has(NEG, HERE) and bits & (THING | PART) != 0
        or has(ACT, YOU, THING)
        or has(TECH, ACT)
        or has(TECH, NEG)
        or has(TECH, YOU) and bits & (STATE | ASK) != 0
        or bits & SAMPLE != 0
        or has(FILL, HERE) and bits & (LATER | YOU | PART) != 0
        or has(FILL, PART)
        or has(FILL, LATER)
        or bits & FILL != 0 and (("to", "be") in zip(words, words[1:]) or not FUTURE.isdisjoint(words))
        or has(PART, HERE) and len(words) <= 4
        or has(ASK, THING) and not other and ended
        or bits & LATER != 0 and known >= 2 and not other and len(words) <= 4
        or kinds(words[0]) & PART != 0 and words[1:2] == ["of"] and len(words) <= 5 and other <= 1
        or has(PART, LATER)
        or has(HERE, LATER)
        or has(ASK, LATER)
        or has(ASK, YOU, THING)
        or has(ASK, ACT) and bits & (THING | YOU) != 0
    )


def verdict(template: str, masked: Sequence[int] = ()) -> int:
    """JUNK, NEUTRAL, UNSURE or CONTENT, by the words of a template; ``masked`` has the classes of the words
    that its wildcards stand for, 0 where one of them is in none."""
    values, wild = template.count(VALUE), template.count(WILD)
    words = [w.lower().replace("’", "'") for w in _WORD.findall(_MASKS.sub(" ", template))]
    if not words:
        return NEUTRAL if values < 3 else CONTENT
    if _meaningless(words):
        return JUNK
    if values >= 3 or _LOGGED.search(template):
        return CONTENT
    bits = known = other = narrated = 0
    for w in words:
        k = kinds(w)
        bits |= k
        if k & NARRATED:
            narrated += 1
        if k & ~(NARRATED | HERE | YOU):
            known += 1
        elif k == 0 and (len(w) > 1 and w not in FUNCTION_WORDS):
            other += 1
    for k in masked:
        bits |= k
        if k & ~(NARRATED | HERE | YOU):
            known += 1
            wild -= 1
    if wild or values > 1:
        other += 0.25 * wild + 0.5 * (values - 1 if values > 1 else 0)  # places of values, not words
    other += narrated
    cover = known / (known + other) if known + other else 0.0
    ended = _END.search(template) is not None
    if _core(bits, words, known, other, ended):
        if len(words) == 1 and not bits & (FAULT | SAMPLE):
            return NEUTRAL
        if cover >= SURE_COVER:
            return JUNK
        return UNSURE if cover >= UNSURE_COVER or len(words) <= 3 else CONTENT
    if len(words) <= 3 or _RULES.search(template) and len(words) <= 12:
        return NEUTRAL
    if words[0] != template[:1].lower() and len(words) <= 7 and not ended:
        return NEUTRAL
    if cover >= SURE_COVER:
        return UNSURE
    return UNSURE if len(words) <= 6 or cover >= UNSURE_COVER and len(words) <= 8 else CONTENT
