"""Problem 10: template residue, filler and error-page text.

Method: grammars for unfilled placeholders, one for each kind of delimiter,
patterns for filler, and the density of the words that error pages and
scripts-required notices are made of. Code blocks and inline code are taken out
first; quotations and text about such things are discounted by their context,
and filler and notices count only where at most one real sentence stands beside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: At most so many real sentences beside filler or an error text.
REAL_SENTENCES = 1

# ---- code, quotations, markup ------------------------------------------------

FENCE = re.compile(r"(?ms)^[^\S\n]*(?:\[\d\d:\d\d\]\s*|>\s*|[-*]\s+|\d+\.\s+)?(```+|~~~+).*?(?:^[^\S\n]*\1[`~]*[^\n]*$|\Z)")
INLINE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
TAG = re.compile(r"<(?:/?(?:p|b|i|u|a|em|strong|span|div|br|hr|h[1-6]|ul|ol|li|table|thead|tbody|tr|td|th|html|head|body|title|article|section|header|footer|nav|main|pre|code|blockquote|img|sup|sub|small|script|style|meta|link|form|input|button|label|!doctype|!--)\b[^<>]*)>", re.I)
CODE_TAG = re.compile(r"(?is)<(pre|code|script|style)\b[^>]*>.*?</\1\s*>")
BLOCK_TAG = re.compile(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|br|hr|title|head|body|html|blockquote)\b[^<>]*>")

# ---- placeholders: a grammar for each delimiter --------------------------------

_WORD = r"[A-Za-z][A-Za-z0-9]*"
_NAME = rf"{_WORD}(?:[_.\-]{_WORD}|[_\-]\d+)*"
_PHRASE = rf"{_NAME}(?: {_NAME}){{0,4}}"
_FILTER = rf"(?:\s*\|\s*{_NAME}(?:[:(][^{{}}\n]{{0,40}})?)*"
PLACEHOLDERS = [
    re.compile(x)
    for x in (
        rf"\{{\{{[-#^/&!]?\s*{_PHRASE}{_FILTER}\s*-?\}}\}}",  # {{ name | default }}
        rf"(?<![\w$#%{{])\{{(?:{_NAME}|\d{{1,2}}|{_NAME} {_NAME})\}}(?!\}})",  # {name} {0}
        rf"\$\{{{_NAME}(?::?[-=?+][^{{}}\n]{{0,40}})?\}}",  # ${NAME}
        r"(?<![\w$\\])\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\b",  # $NAME
        rf"#\{{{_NAME}\}}",  # #{name}
        rf"<%[-=]?\s*{_PHRASE}\s*-?%>",  # <%= name %>
        rf"(?<![%\w])%\({_NAME}\)[sdrif]",  # %(name)s
        r"(?<![%\w])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?!\w)",  # %NAME%
        r"@@[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*@@",  # @@NAME@@
        r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",  # __NAME__
        rf"\[\[\s*{_PHRASE}\s*\]\]",  # [[name]]
        rf"<<\s*{_PHRASE}\s*>>",  # <<name>>
        rf"«\s*{_NAME}(?: {_NAME})?\s*»",  # «name»
        r"(?i)\[(?:insert|enter|add|your|tbd|todo|fill(?: in)?|placeholder|replace)\b[^\[\]\n]{0,60}\]",  # [INSERT NAME]
        r"\[[A-Z][A-Z]+(?:[ _][A-Z]+)+\]",  # [PROJECT NAME]
        r"(?i)<(?:your|insert|enter|add|the|my)[ _-][^<>\n]{1,60}>",  # <your name here>
        r"(?i)<[a-z][a-z _-]{0,40} here>",
        r"(?i)\((?:tbd|tbc|todo|to be (?:done|decided|defined|added|filled(?: in)?)|fill in|insert)\b\s*:?[^()\n]{0,60}\)",  # (TBD: name)
        r"(?<![\w/])X{4,}(?![\w/])",  # XXXX
        r"(?<![\w_])_{5,}(?![\w_])",  # _____
    )
]

#: Words by which a text speaks of a placeholder or a notice instead of having one.
ABOUT = re.compile(r"(?i)\b(?:template|placeholder|marker|format string|style guide|linter|the mailer|mail merge|variables?|syntax|regex|is replaced|are replaced|filled (?:in )?(?:at|from|by)|escaped?|is written as|literal(?:ly)?)\b")
_MARKS = re.compile(r"[\"“”„'‘’]\s*$")

# ---- filler ----------------------------------------------------------------------

FILLER = [
    re.compile(x, re.I)
    for x in (
        r"^lorem ipsum\b",
        r"^(?:sample|dummy|placeholder|filler|example|demo|blind) (?:text|content|copy|paragraph)(?: goes| comes)?(?: here)?\b.{0,20}$",
        r"^(?:your|add|insert|enter|put|type|write|replace|edit)\b.{0,25}\b(?:text|content|copy|paragraph|introduction|description|title|heading)\b.{0,25}\b(?:here|your own|this section|own)\b.{0,20}$",
        r"^(?:text|content|description|title) (?:goes |comes )?here$",
        r"^(?:title|subtitle|heading|subheading|(?:first|second|third|fourth|another) (?:point|item|bullet)|(?:item|point|bullet|section|paragraph|heading|column) (?:one|two|three|\d))$",
        r"^(?:click|tap) (?:here )?to (?:add|edit)\b.{0,30}$",
        r"^(?:coming soon|under construction|to be (?:written|completed|done|continued)|tbd|todo|n/?a|no content(?: yet)?|content pending)$",
        r"^(?:texto|texte|text|beispieltext|platzhalter|blindtext|texto de (?:ejemplo|relleno)|texte d['’]exemple|faux texte|示例文本|占位文本|此处填写.{0,8}|在此输入.{0,8})$",
    )
]

# ---- error pages and notices ---------------------------------------------------------

#: HTTP status codes from 400 on.
_CODE = re.compile(r"(?:4(?:0[0-9]|1[0-8]|2[0-9]|31|51)|5(?:0[0-9]|1[01]|2[0-9]))")
#: Words that error pages, sign-in walls, bot checks, maintenance and scripts-required notices are made of, by language:
#: a sentence of such a page has one of the first list and hardly a word that is in neither.
CORE = {
    "en": """error errors failure failed fault exception oops whoops sorry found missing gone exist exists existed unavailable available moved deleted removed expired broken wrong invalid denied forbidden access slow rate
        unauthorized refused rejected blocked banned restricted permission permissions rights allowed authorized login signin sign log signed logged password account members subscribers session browser
        javascript scripts script scripting cookies enable enabled disabled activate captcha human robot verify verifying verification checking security maintenance upkeep down offline overloaded
        busy timeout timed gateway server upstream internal request requests quota limit reached exceeded exceed many retry retrying reload refresh again later redirected forwarded redirect waiting wait
        patience notified informed incident reference ray support administrator webmaster owner nothing unexpected occurred happened address mistyped homepage upgrade outdated unsupported
        temporarily went paused puzzle challenge continue unable load problem problems bad broke crashed crash raised thrown uncaught unhandled moment second come used allows""",
    "de": """fehler seite adresse nicht gefunden existiert verfügbar zugriff zugang verweigert gesperrt wartung wartungsarbeiten javascript skripte cookies erlauben aktivieren einschalten abgeschaltet deaktiviert
        erforderlich braucht benötigt versuchen später erneut anmelden anmeldung browser vorgang eingabe prüfen überprüfen zurück laden sitzung abgelaufen server""",
    "es": """error página pagina encontrada existe disponible acceso denegado restringido prohibido mantenimiento servicio suspendido javascript scripts cookies active activa habilite necesita vuelva volvemos
        inténtelo intente tarde código dirección mal sesión servidor navegador""",
    "fr": """erreur introuvable trouvée inexistante indisponible existe accès refusé interdit maintenance javascript scripts cookies activez activer désactivé requis nécessaire réessayez retour accueil
        adresse session serveur navigateur""",
}
SIDE = {
    "en": """a an and any anything are as at back be been before but by can cannot can't could couldn't did do does doesn't don't for from get go had has have haven't he here home how i if in into is isn't it its itself just
        lack let may me might moment moments more must my need needed needs needing new no not now of off on once one only or our out page pages please press return second seconds minute minutes hour hours shortly
        should site sites so something start step still such take team than thank thanks that the their them there they this those to too try trying turn turned until up url use using view visit was we web website
        were what when where which while who will with won't work working works would you your yours link links document file article resource content app application viewer search box spelling check complete
        click button continue contact email id code number key case event trace ticket act action while proceed shown show display read see open run runs automatic automatically switch switched switching
        required requires require sent made calls reply response answer gave returned service services soon being it's we'll we're you're looking looked everywhere never old lead leads anywhere connection ip your
        create forgot forgotten lost ask asked tell told alert alerted engineers administrators first main front little bit few plan side sides processing rendering rendered displaying fatal internal unknown another again status http gateway device network safe rule rules firewall protect protected process""",
    "de": """die der das diese dieser dieses es ist sind wir sie ihre ihr bitte gibt hier in im auf und oder um zu den dem ein eine wurde werden wieder gleich bald da fortzufahren fortfahren weiter seite einmal noch für mit nach
        uns gerade kurz inhalt sehen anzeigen anwendung website angeforderte neu webseite team informiert einen moment geduld ihrem ihren nicht mehr unter von startseite zur""",
    "es": """la el los las esta este esto ya no en de para por más y o un una se su sus algo salió ha sido a al inicio página favor sitio con continuar pronto lo sentimos está""",
    "fr": """la le les cette ce ces l d n est pas plus en de du des pour par et ou un une se sa son à au a été votre vos nous vous veuillez continuer site accueil merci plus tard dans interne""",
}
CORE_WORDS = frozenset(w for text in CORE.values() for w in text.split())
SIDE_WORDS = frozenset(w for text in SIDE.values() for w in text.split())
#: The same for Chinese, where words aren't parted: terms that cover nearly all of a sentence.
ZH_CORE = re.compile(r"页面|网页|该页|地址|网址|不存在|未找到|找不到|已失效|禁止访问|服务器|错误|拒绝访问|访问被拒绝|无权访问|访问受限|受限|稍后|重试|登录|启用|开启|打开|脚本|浏览器|系统维护|维护|服务暂停|暂停|编号|错误码|检查|返回首页|验证")
ZH_SIDE = re.compile(r"[您你请的了中或并再试需要未不支持访问以继续查看内容本站首页后前在与和是否此该已被无法功能时间我们正在进行将会很快恢复抱歉对起]|[0-9a-fA-F]+|javascript")
#: So many of a sentence's words are of the lists; and no sentence of a notice is longer.
NOTICE_SHARE = 0.8
NOTICE_WORDS = 18
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{4,}(?:-[0-9a-f]+)*|\d{1,3}", re.I)


def notice_kind(sentence: str) -> str | None:
    """'notice' if the sentence is made of the words of error pages and
    notices, 'beside' if only of those that stand there too, else None."""
    tokens = [t.replace("’", "'").lower() for t in _TOKEN.findall(sentence)]
    if not tokens or len(tokens) > NOTICE_WORDS:
        return None
    if re.search(r"[\u4e00-\u9fff]", sentence):
        signs = re.sub(r"[\W_]+", "", sentence)
        core = sum(len(m.group()) for m in ZH_CORE.finditer(signs))
        side = sum(len(m.group()) for m in ZH_SIDE.finditer(ZH_CORE.sub("", signs)))
        size = len(signs)
    else:
        # An elided article is no part of the word: l'accueil.
        tokens = [t if t in CORE_WORDS or t in SIDE_WORDS else t.rpartition("'")[2] for t in tokens]
        core = sum(t in CORE_WORDS or bool(_CODE.fullmatch(t)) for t in tokens)
        side = sum(t not in CORE_WORDS and not _CODE.fullmatch(t) and (t in SIDE_WORDS or bool(_HEX.fullmatch(t))) for t in tokens)
        size = len(tokens)
    if core + side < NOTICE_SHARE * size:
        return None
    return "notice" if core else "beside"


#: What surrounds any page: menus and footers. Neither real text nor residue.
FURNITURE = re.compile(r"(?i)^(?:home|docs|search|sign in|log ?in|menu|overview|sessions?|reports?|help|contact|about|imprint|privacy|skip to content|cookie settings|back to top|© .{0,40}|\(c\) .{0,40}|all rights (?:kept|reserved)|(?:\w+ \| )+\w+(?: \w+)?)$")
QUOTED_LINE = re.compile(r"^\s*(?:\[\d\d:\d\d\]\s*|\d+\.\s+|[-*]\s+|(?:user|assistant|system)\s*:\s*)?>\s?")
LEAD = re.compile(r"^(?:\s*(?:\[\d\d:\d\d\]|\d{1,2}\.(?=\s)|[-*#•]+(?=\s)|(?:user|assistant|system|subject)\s*:(?=\s)))+\s*", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+(?=\S)|(?<=[。！？；])\s*| - (?=\S)| – (?=\S)|(?<=\d): (?=\D)")
OUTER = re.compile(r"^[\s\"'“”‘’*_#=~>|•-]+|[\s\"'“”‘’*_=~|.!?。！？…,;:-]+$")


def without_code(text: str) -> str:
    """The text without fenced and inline code and without the content of code tags."""
    text = FENCE.sub("\n", text)
    text = CODE_TAG.sub(" ", text)
    return INLINE.sub(" \x00 ", text)


def _quoted(text: str, start: int, end: int) -> bool:
    """Is the place directly within quotation marks?"""
    return bool(_MARKS.search(text[max(0, start - 2) : start])) and bool(re.match(r"\s*[\"“”'‘’]", text[end : end + 2]))


def placeholders(text: str) -> int:
    """Unfilled places in running text, without those that are talked about."""
    found = 0
    for grammar in PLACEHOLDERS:
        for m in grammar.finditer(text):
            if QUOTED_LINE.match(text[text.rfind("\n", 0, m.start()) + 1 : m.start() + 1]):
                continue
            if _quoted(text, m.start(), m.end()):
                continue
            a = max(text.rfind(". ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            b = min((x for x in (text.find(". ", m.end()), text.find("\n", m.end())) if x >= 0), default=len(text))
            if ABOUT.search(text, a, m.start()) or ABOUT.search(text, m.end(), b):
                continue
            found += 1
    return found


def repeated(words: list[str]) -> bool:
    """A text of a few words over and over: asdf asdf asdf, test test 123."""
    return len(words) >= 8 and len(set(words)) <= min(6, max(1, len(words) // 6))


#: Words of the usual filler, by which its further sentences are known.
LATIN = frozenset(
    """a ac accumsan ad adipiscing adipisicing aenean aliqua aliquam aliquet aliquip amet anim ante aptent arcu at auctor augue aute bibendum blandit cillum class commodo condimentum congue consectetur consectetuer consequat conubia convallis cras cubilia culpa cum cupidatat curabitur curae cursus dapibus deserunt diam dictum dictumst dignissim dis do dolor dolore donec dui duis ea egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisi facilisis fames faucibus felis fermentum feugiat fringilla fugiat fusce gravida habitant habitasse hac hendrerit iaculis id imperdiet in incididunt inceptos integer interdum ipsum irure justo labore laboris laborum lacinia lacus laoreet lectus leo libero ligula litora lobortis lorem luctus maecenas magna magnis malesuada massa mattis mauris metus mi minim molestie mollis mollit montes morbi mus nam nascetur natoque nec neque netus nibh nisi nisl non nostra nostrud nulla nullam nunc occaecat odio officia orci ornare parturient pariatur pellentesque penatibus per pharetra phasellus placerat platea porta porttitor posuere potenti praesent pretium primis proident proin pulvinar purus qui quam quis quisque reprehenderit rhoncus ridiculus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sociis sociosqu sodales sollicitudin sunt suscipit suspendisse taciti tellus tempor tempus tincidunt torquent tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula vel velit veniam venenatis vestibulum vitae vivamus viverra volutpat voluptate vulputate""".split()
)


def latin(sentence: str) -> bool:
    """Are at least half of its words those of the usual filler?"""
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    return bool(words) and 2 * sum(w in LATIN for w in words) >= len(words)


def shares(text: str, most_real: int = 1 << 30) -> tuple[int, int, int]:
    """(sentences of filler, of error pages and notices, real ones). Counting
    ends where there are more than most_real real ones, which settles the text.
    Latin sentences are filler from the first one of filler on."""
    filler = notice = real = beside = 0
    flat = BLOCK_TAG.sub("\n", text)
    flat = TAG.sub("", flat)
    for line in flat.split("\n"):
        if real > most_real:
            break
        if QUOTED_LINE.match(line) and line.strip(" >"):
            real += 1
            continue
        line = LEAD.sub("", line).strip()
        if not line or FURNITURE.match(OUTER.sub("", line) or line):
            continue
        if repeated(line.lower().split()):
            filler += 1
            continue
        for part in SENTENCE.split(line):
            if real > most_real:
                break
            bare = OUTER.sub("", part or "")
            if not bare:
                continue
            if any(f.match(bare) for f in FILLER) or (filler and latin(bare)):
                filler += 1
            elif FURNITURE.match(bare):
                continue
            elif (kind := notice_kind(bare)) == "notice":
                notice += 1
            elif kind == "beside":
                beside += 1
            elif not re.search(r"\w", bare):
                continue
            else:
                real += 1
    # What only uses such a page's common words belongs to it where there is one, and is a real sentence elsewhere.
    return filler, notice, real if notice else real + beside


def judge(text: str | None) -> str | None:
    """'placeholder', 'filler', 'notice' or None for real, empty and null texts."""
    if not text or not text.strip():
        return None
    body = without_code(text)
    if placeholders(body):
        return "placeholder"
    filler, notice, real = shares(body, REAL_SENTENCES)
    if filler and real <= REAL_SENTENCES:
        return "filler"
    if re.match(r"(?i)lorem ipsum\b", body.strip()):
        return "filler"
    if notice and real <= REAL_SENTENCES:
        return "notice"
    return None


def _judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([judge(t) for t in b.column("text").to_pylist()], pa.string())], names=["doc_id", "residue"])


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, residue ('placeholder', 'filler' or 'notice') of the documents
    that are template residue instead of content.

    Whole texts are judged, one by one, so that no group is ever gathered.
    Null and blank texts are no residue; copies are judged alike; extra
    columns are ignored; no documents give no rows.
    """
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_judge_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, residue string").where("residue is not null")


def clean(documents: DataFrame) -> DataFrame:
    """The documents without residue, with all their columns."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")


