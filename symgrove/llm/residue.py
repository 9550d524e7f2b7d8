"""Template residue, filler and error pages among documents.

Labelled exemplars of residue stand in an inverted index, term by term. Every
passage window of every document (up to three sentences of a line) retrieves exemplars
by the terms they share; TF-IDF containment, with the document frequencies of all
terms over the whole corpus, says how much of the passage an exemplar, or
up to three of one label, account for. A document whose passages are residue for the
most part, page furniture aside, is excluded. So is one in whose running text a
template variable stands unfilled: there the passage is the slot itself, its names
masked, and the exemplar it retrieves must be it whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut

#: Share of a passage's TF-IDF weight that one exemplar, or JOINED of one label together, must hold; share of a text that must be residue.
CONTAINMENT, TOGETHER, COVERAGE = 0.7, 0.85, 0.5
JOINED = 3
#: Share of a passage's terms that retrieves an exemplar before the weights are known.
RETRIEVAL = 0.45

#: The labelled exemplars.
EXEMPLARS: dict[str, str] = {
    "error": """404 Not Found
The page you asked for could not be located on this server.
The requested URL was not found on this server.
Page not found. The page you are looking for does not exist.
We could not find any page with that name. Try the search instead.
Sorry, we can't find that page.
This document has been moved or deleted.
This page is no longer available. It may have been removed.
403 Forbidden
You don't have permission to access this resource.
Access denied. You do not have permission to view this resource.
Please log in again. Sign in to continue.
401 Unauthorized. Authentication required.
You must be signed in to view this page. Please log in.
Your session has expired. Sign in again to continue reading.
500 Internal Server Error
Internal server error (500)
The server encountered an internal error and was unable to complete your request.
An unexpected error has occurred. Please try again later.
Oops! Something went wrong on our side. Try again in a few minutes.
Something went wrong. Please reload the page.
502 Bad Gateway
The upstream answered with an invalid response.
503 Service Unavailable
Service temporarily unavailable
The service is currently unavailable. Please try again later.
The site is down for maintenance. We will be back soon.
The wiki is down for maintenance.
504 Gateway Timeout
The gateway did not receive a timely response from the upstream server.
The connection has timed out. The server took too long to respond.
Too many requests. Slow down and retry after 30 seconds.
Rate limit exceeded. Please wait and try again.
Your request has been blocked. Suspicious activity was detected.
Checking your browser before letting you in. Ray abc123
Please complete the captcha to prove you are not a robot. Verify you are human.
Database connection lost. The article could not be fetched.
Error establishing a database connection
Unable to load this page. The content could not be loaded.
Traceback: renderer stopped while loading this page
Traceback (most recent call last): error while rendering this page
Request id abc123
Trace abc123
Reference number incident id error code
error code message document not available id
error status code message not found
400 Bad Request. Your browser sent a request that this server could not understand.
410 Gone. The resource is no longer available on this server.
nginx proxy server gateway timeout html head title body hr
404 页面不存在
您访问的文档已被删除或移动。
页面未找到。您访问的页面不存在或已被删除。
没有权限查看该页面，请先登录。
拒绝访问。您没有权限访问此页面。
服务器内部错误，请稍后再试。编号
服务暂时不可用，请稍后重试。系统维护中。
请求过于频繁，请稍后再试。
会话已过期，请重新登录。
请完成验证码验证。正在检查您的浏览器。
Fehler 404: Die angeforderte Seite wurde nicht gefunden.
Seite nicht gefunden. Die Seite existiert nicht oder wurde verschoben.
Zugriff verweigert. Bitte melden Sie sich erneut an.
Sie haben keine Berechtigung, diese Seite anzuzeigen.
Der Dienst steht zurzeit nicht zur Verfügung. Vorgang abc123
Interner Serverfehler. Bitte versuchen Sie es später erneut.
Ihre Sitzung ist abgelaufen. Zu viele Anfragen. Wartungsarbeiten
Erreur 404 : la page demandée est introuvable.
Page non trouvée. Cette page n'existe pas ou a été déplacée.
Accès refusé. Veuillez vous connecter pour lire ce document.
Veuillez vous identifier à nouveau. Reconnectez-vous.
Vous n'avez pas l'autorisation d'accéder à cette page.
Erreur interne du serveur. Veuillez réessayer plus tard.
Service temporairement indisponible. Site en maintenance. Votre session a expiré. Trop de requêtes
Error 404: no se encontró la página solicitada.
Página no encontrada. La página no existe o fue movida.
Acceso denegado. Inicie sesión para ver este documento.
Vuelva a iniciar sesión. Identifíquese de nuevo.
No tiene permiso para acceder a esta página.
Error interno del servidor. Vuelva a intentarlo más tarde.
El servicio no está disponible en este momento. Sitio en mantenimiento. Su sesión ha caducado. Demasiadas solicitudes
404 ページが見つかりません。
URLをご確認ください。
お探しのページは見つかりませんでした。移動または削除された可能性があります。
アクセスが拒否されました。もう一度ログインしてください。
このページを表示する権限がありません。
サーバー内部エラーが発生しました。しばらくしてからもう一度お試しください。
サービスは現在ご利用いただけません。メンテナンス中です。セッションの有効期限が切れました。
Ошибка 404. Запрошенная страница не найдена.
Страница не найдена. Страница не существует или была перемещена.
Доступ запрещён. Войдите снова, чтобы просмотреть документ.
Войдите в систему ещё раз. Пожалуйста, авторизуйтесь.
У вас нет прав для просмотра этой страницы.
Внутренняя ошибка сервера. Повторите попытку позже.
Сервис временно недоступен. Ведутся технические работы. Сеанс истёк. Слишком много запросов""",
    "script": """Please enable JavaScript to view this documentation.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. The page cannot be shown without it.
JavaScript is required to use this site. Please turn it on and reload.
This viewer requires scripts. Turn them on in your browser settings and reload.
Your browser does not support JavaScript. This site requires JavaScript.
Please enable cookies and JavaScript to continue.
Loading… If nothing happens, scripts may be blocked.
Loading, please wait
Enable scripts in your browser settings and reload the page.
请启用 JavaScript 后再查看本页面。
您的浏览器禁用了脚本，无法显示页面。
您的浏览器不支持脚本，请在设置中开启。正在加载
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
Diese Seite benötigt JavaScript. Ihr Browser unterstützt kein JavaScript. Skripte sind deaktiviert. Wird geladen
Veuillez activer JavaScript pour afficher cette page.
Cette page nécessite JavaScript. Les scripts sont désactivés dans votre navigateur. Chargement en cours
Active JavaScript en su navegador para ver esta página.
Esta página requiere JavaScript. Los scripts están desactivados en su navegador. Cargando
このページを表示するにはJavaScriptを有効にしてください。
お使いのブラウザではスクリプトが無効になっています。読み込み中です。
Чтобы просмотреть эту страницу, включите JavaScript.
Для работы сайта требуется JavaScript. Скрипты отключены в вашем браузере. Загрузка""",
    "filler": """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
urna augue justo felis tellus congue lacus donec ornare vitae rutrum turpis pretium mauris morbi porta pellentesque vestibulum vivamus nunc mattis faucibus eget massa ante nibh leo orci purus ligula sapien cras semper aenean fusce praesent suspendisse phasellus curabitur integer maecenas quisque sollicitudin tincidunt bibendum egestas gravida habitant hendrerit iaculis interdum lectus libero luctus malesuada metus molestie natoque netus odio placerat posuere potenti proin pulvinar risus sagittis scelerisque senectus sem sociis sodales tortor tristique ultrices ultricies varius vehicula vel venenatis viverra volutpat accumsan aliquet arcu auctor blandit commodo condimentum convallis cursus dapibus diam dictum dignissim dui efficitur elementum erat eros etiam euismod facilisis feugiat finibus fringilla hac imperdiet lacinia laoreet lobortis magnis maximus mi nam neque nisl nullam pharetra platea porttitor primis quam rhoncus sed ut
test test test
xxx xxx xxx
blah blah blah
bla bla bla
asdf asdf asdf jkl jkl qwerty
foo foo foo
Placeholder paragraph, replace before publishing.
Placeholder text. Dummy text. This text will be replaced.
Sample text for this section.
Text to be supplied. Content to be added. To be written.
Content coming soon.
This page is under construction. Coming soon. Check back later.
Insert text here. Your text here. Type your content here.
Texte de remplissage à remplacer.
Contenu à venir. Texte d'exemple. Page en construction.
Texto de relleno para la maqueta.
Contenido próximamente. Texto de ejemplo. Página en construcción.
Hier steht ein Blindtext, der noch ersetzt wird.
Platzhaltertext. Inhalt folgt in Kürze. Beispieltext. Seite im Aufbau.
这里是占位文字，待补充正文。
示例文本，内容待补充，敬请期待，即将上线。占位内容
ここに本文が入ります。
ダミーテキストです。サンプルテキスト。準備中です。
Здесь будет текст. Текст-заполнитель. Страница в разработке. Содержимое скоро появится. Рыба-текст. Пример текста""",
    "furniture": """Back to overview
Back to top. Back to home. Previous. Next
Home | Docs | Search
Menu
Symbols
Branches
Login
Log in. Sign in. Sign up. Register. Sign out
Skip to content
Skip to main content. Skip to navigation
Report this problem
Contact us. Contact support. Help. About. Privacy policy. Terms of service. Imprint. Cookies
documentation portal
© maintainers
© All rights reserved. Powered by
Search. Navigation. Share. Print. Download. Edit this page. Last updated""",
    "template": """{{ name }} {{ NAME }} {{{name}}} {{{NAME}}} {% name %} {% NAME %} <%= name %> <%= NAME %> <% name %> ${name} ${NAME} #{name} #{NAME} @@name@@ @@NAME@@ %(name)s %(NAME)s %NAME% %%NAME%% __NAME__ {name} {NAME}
<YOUR NAME> <INSERT NAME> <ENTER NAME> <ADD NAME> <TODO NAME> <your name> <insert name> <enter name> <YOUR NAME HERE> <INSERT NAME HERE> <ENTER NAME HERE> <ADD NAME HERE> <your name here> <insert name here> <enter name here> <INSERT YOUR NAME> <ENTER YOUR NAME> <insert your name> <enter your name>
<NAME_PLACEHOLDER> <NAME_HERE> <NAME_GOES_HERE> <NAME_TBD> <PLACEHOLDER>
[YOUR NAME] [INSERT NAME] [ENTER NAME] [ADD NAME] [FILL IN NAME] [your name] [insert name] [enter name] [fill in name] [YOUR NAME HERE] [INSERT NAME HERE] [ENTER NAME HERE] [ADD NAME HERE] [your name here] [insert name here] [enter name here] [INSERT YOUR NAME] [ENTER YOUR NAME] [insert your name] [enter your name] [fill in your name] [FILL IN YOUR NAME]
[name goes here] [NAME GOES HERE] [name to be added] [NAME TO BE ADDED] [name to be filled in] [NAME TO BE FILLED IN] [name here] [NAME HERE] [object Object]
[Ihr Name einfügen] [Name hier einfügen] [hier Name einfügen] [Ihr Name eintragen] [hier eintragen] [hier einfügen] [votre nom] [insérer nom] [insérer votre nom] [su nombre] [su nombre aquí] [inserte nombre] [inserte nombre aquí] [inserte su nombre] [inserte su nombre aquí] [insertar nombre] [insertar nombre aquí]
【请填写名称】 【填写名称】 【请输入名称】 【输入名称】 【请插入名称】 【插入名称】 【请补充名称】 【补充名称】""",
}

_NUMBER = re.compile(r"\b(?:\d+|(?=[a-f]*\d)[0-9a-f]{6,})\b")
_ASCII = re.compile(r"#|[a-z]+(?:'[a-z]+)?|[a-z]*\d\w*")
_WORD = re.compile(r"#|[ぁ-ヿ㐀-䶿一-鿿々ー]+|[^\W_ぁ-ヿ㐀-䶿一-鿿]+(?:'[^\W\d_]+)?")
_WIDE = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿]")


def terms(passage: str) -> set[str]:
    """Terms of a passage: words in lower case, numbers as one sign, pairs of characters of Chinese and Japanese."""
    low = _NUMBER.sub("#", passage.lower())
    if low.isascii():
        return set(_ASCII.findall(low))
    out: set[str] = set()
    for w in _WORD.findall(low.replace("’", "'")):
        if _WIDE.match(w):
            out.update([w[i : i + 2] for i in range(len(w) - 1)] or [w])
        else:
            out.add(w)
    return out


#: Signs around a template's slot, longest first.
DELIMITERS = (("{{{", "}}}"), ("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("@@", "@@"), ("%%", "%%"), ("%(", ")"), ("__", "__"), ("%", "%"), ("<", ">"), ("[", "]"), ("【", "】"), ("{", "}"))
#: Words that stay in a masked slot of words.
CUES = frozenset("your insert enter add todo placeholder here goes tbd fill in to be added filled object ihr hier einfügen eintragen votre insérer su inserte insertar aquí".split())
_WIDE_CUE = re.compile(r"请?(填写|输入|插入|补充)")
_BEFORE, _AFTER = {"{": r"(?<![A-Za-z0-9_$#%{\\\"'])", "__": r"(?<![A-Za-z0-9_.])"}, {"{": r"(?![A-Za-z0-9_}])", "__": r"(?![A-Za-z0-9_])", "%(": "[sdif]"}
_BODY = {"{": r"[A-Za-z_]+", "__": r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*", "%": r"[A-Z][A-Z]*(?:_[A-Z]+)*", "%%": r"[A-Z_]+", "@@": r"[A-Za-z_]\w*", "%(": r"[A-Za-z_]\w*", "${": r"[^\W\d][\w.]*", "#{": r"[^\W\d][\w.]*", "【": "[^】]*", "<%": r"[=-]?\s*[\w.@\s]+-?", "{%": r"-?\s*[^\W\d][\w.\s]*-?", "<": r"[A-Za-z_ -]+", "[": r"[\w -]+"}
_SLOT = re.compile("|".join(f"{_BEFORE.get(o, '')}(?:{re.escape(o)}{_BODY.get(o, r'[^\W\d][\w.\s|-]*') if o[:2] != '{{' else r'\s*[^\W\d][\w.\s|-]*'}{re.escape(c)}){_AFTER.get(o, '')}" for o, c in DELIMITERS))


def masked(slot: str) -> str:
    """A slot with its names masked: upper case as A, all else as a; cue words stay in slots of words."""
    o, c = next(d for d in DELIMITERS if slot.startswith(d[0]))
    body = slot[len(o) : -len(c) - (o == "%(")]
    if o == "【":
        m = _WIDE_CUE.match(body)
        return f"【{m[1]}】" if m else "【】"
    words = re.findall(r"[^\W_]+", body)
    if o not in "<[":
        return f"{o}{'A' if body.upper() == body else 'a'}{c}"
    kept = [w.lower() if w.lower() in CUES else "A" if w.upper() == w else "a" for w in words]
    return o + " ".join(k for i, k in enumerate(kept) if not i or k != kept[i - 1]) + c


def _bank() -> list[tuple[str, frozenset[str]]]:
    slots = [("template", frozenset([masked(m[0])])) for m in _SLOT.finditer(EXEMPLARS["template"])]
    return [(label, frozenset(terms(line))) for label, lines in EXEMPLARS.items() if label != "template" for line in lines.split("\n")] + slots


BANK = _bank()
INDEX: dict[str, list[int]] = {}
for _i, (_label, _terms) in enumerate(BANK):
    for _t in _terms:
        INDEX.setdefault(_t, []).append(_i)
LABELS = {label: frozenset().union(*(t for k, t in BANK if k == label)) for label in EXEMPLARS if label != "template"}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")

#: Names that are no template's.
_NOT_VARIABLE = re.compile(
    r"^(?:\$\{(?:HOME|PATH|PWD|USER|SHELL|TMPDIR|TMP|TEMP|LANG|HOSTNAME|[A-Z]+_(?:HOME|ROOT|DIR|PATH))\}|%(?:PATH|HOME|USERPROFILE|APPDATA|LOCALAPPDATA|TEMP|TMP|SYSTEMROOT|WINDIR|PROGRAMFILES|COMSPEC|OS)%|__(?:FILE|LINE|FUNCTION|DATE|TIME|COUNTER|STDC|GNUC|VA_ARGS|BASE_FILE|PRETTY_FUNCTION|TIMESTAMP|OBJC|ELF|LP64|CUDACC|ASSEMBLER|VA_OPT)(?:_\w+)?__)$"
)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]{0,80}\"|“[^”\n]{0,80}”|«[^»\n]{0,80}»|„[^“”\n]{0,80}[“”]|「[^」\n]{0,80}」|<code>.*?</code>")
_EXPLAINS = re.compile(
    r"\bsuch as\b|\bof the kind\b|\bplaceholders?\b(?!_)|\btemplate variables?\b|\bmacros?\b|\bexpands? to\b|\bsyntax\b|\bis replaced (?:by|with)\b|\bare replaced (?:by|with)\b|\bpatterns?\b|\bwritten like\b|\bescap(?:e|ed|ing)\b|\benvironment variable|\bformat string|Platzhalter|Vorlagenvariable|espaces? réservés?|variables? de (?:gabarit|modèle)|marcador(?:es)? de posición|variables? de plantilla|占位符|模板变量|プレースホルダ|テンプレート変数|заполнител|переменн\w+ шаблон",
    re.I,
)
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def slots(sentence: str) -> list[str]:
    """Slots of a sentence whose masked form retrieves an exemplar of a template from the index."""
    return [m[0] for m in _SLOT.finditer(sentence) if masked(m[0]) in INDEX]


def variables(text: str) -> list[str]:
    """Template variables that stand unfilled in running text.

    The slots retrieved are checked for what stands around them: not code, quotes
    or an explanation of such things.
    """
    if not any(_SLOT.match(text, m.start()) for m in _MAYBE.finditer(text)):
        return []
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not _MAYBE.search(line) or re.match(r"(?: {4}|\t)", line):
            continue
        for s in _SENTENCE.split(line):
            bare = _QUOTED.sub(" ", s)
            found = [x for x in slots(bare) if not _NOT_VARIABLE.match(x)]
            if found and not _EXPLAINS.search(_SLOT.sub(lambda m: " " if masked(m[0]) in INDEX else m[0], bare)) and not re.match(r"\s*(?:export|set|sudo|cd|echo|index|docker|curl|git)\s+\S*[-=/$]|\s*[\w.]+ --?\w", s):
                out += found
    return out


_MAYBE = re.compile(r"\{(?=[\w{%\s])|\$\{|#\{|<(?=[%A-Zyie])|@@|%(?=[A-Z(%])|__(?=[A-Z])|\[(?=[A-Za-z])|【")


def size(s: str) -> int:
    """Length of a passage in bytes, so that a character of Chinese or Japanese weighs as part of a word."""
    return len(s.encode())


def passages(text: str) -> Counter:
    """Distinct lines of a text with how often they stand in it; indented code and fences keep their indent."""
    out: Counter = Counter()
    fenced = False
    for line in text.split("\n"):
        bare = line.strip()
        if _FENCE.match(line):
            fenced = not fenced
        elif bare:
            out["    " + bare if fenced or line.startswith(("    ", "\t")) else bare] += 1
    return out


def windows(line: str) -> list[str]:
    """Passage windows of a line: its sentences, and neighbouring sentences together, up to three."""
    s = [x.strip() for x in _SENTENCE.split(line) if x.strip()]
    return list(dict.fromkeys(" ".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)))


def is_furniture(line: str, bag: set[str]) -> bool:
    """Short line, no sentence, with a mark or a third of its terms from the furniture exemplars."""
    if len(line) > 80 or re.search(r"[.!?。！？]$", line):
        return False
    return line[0] == "©" or (0 < len(bag) <= 6 and 3 * len(bag & LABELS["furniture"]) >= len(bag))


#: Words of the exemplars that are too common to retrieve one.
COMMON = frozenset(
    "a an the and or of to in on at by for from with without as is are was were be been has have had it its this that you your we our if can could do does not no any all may will more than back again please try later after before file open read name time new # der die das und oder von zu in im auf mit für ist sind wird werden nicht ein eine diese dieser sie bitte noch oder es le la les un une des du de et ou à au en sur pour par est sont ne pas que qui ce cette il vous votre el los las un una y o de del en por para con es son no se su que lo и или не на в с по для что это как его вы до от".split()
)
KNOWN = frozenset(INDEX)
TELLING = KNOWN - COMMON


def retrieve(bag: set[str]) -> dict[str, list[int]]:
    """Exemplars, by label, that share at least RETRIEVAL of the terms, one telling term among them; none where only several of a label do."""
    need = RETRIEVAL * len(bag)
    if len(bag & KNOWN) < need or bag.isdisjoint(TELLING):
        return {}
    hits: Counter = Counter(i for t in bag for i in INDEX.get(t, ()))
    out: dict[str, list[int]] = {}
    for i, n in hits.items():
        if n >= need:
            out.setdefault(BANK[i][0], []).append(i)
    for label, vocabulary in LABELS.items():
        if label not in out and len(bag & vocabulary) >= max(need, 0.7 * len(bag)):
            out[label] = []
    return out


#: Distinct terms a task counts before it hands its counts on.
HELD_TERMS = 200_000


def _scan(batches):
    """One row per document that could be residue, with the terms of its candidate lines; and partial document frequencies of all terms of all documents."""
    total: Counter = Counter()
    n_docs = 0

    cols = ["doc_id", "body", "variables", "cands", "terms", "term", "n"]
    cand = pa.list_(pa.struct([("s", pa.string()), ("n", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), cand, pa.list_(pa.string()), pa.string(), pa.int64()]

    def counted():
        stats = [(None, None, None, None, None, t, n) for t, n in total.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*stats), types)], names=cols)

    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n_docs += 1
            if not text or not text.strip():
                continue
            seen, found, own, body = set(), [], set(), 0
            for s, n in passages(text).items():
                body += size(s.strip()) * n
                if s.startswith("    "):
                    seen |= terms(s)
                    continue
                hit, bag, line = False, set(), set()
                for x in _SENTENCE.split(s):
                    bag = terms(x)
                    line |= bag
                    hit = hit or bool(retrieve(bag))
                seen |= line
                if hit or is_furniture(s, bag):
                    found.append({"s": s, "n": n})
                    own |= line
            total.update(seen)
            var = variables(text)
            if found or var:
                rows.append((i, body, var, found, list(own), None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=cols)
        if len(total) > HELD_TERMS:
            yield counted()
    total[""] = n_docs
    yield counted()


def cover(bag: set[str], label: str, weight: dict[str, float]) -> float:
    """Weight of a passage that a few exemplars of one label account for together; each one added takes the most of what is left."""
    near = {i for t in bag for i in INDEX.get(t, ()) if BANK[i][0] == label}
    left, held = set(bag), 0.0
    for _ in range(JOINED):
        best = max(near, key=lambda i: (sum(weight[t] for t in left & BANK[i][1]), -i), default=None)
        if best is None:
            break
        held += sum(weight[t] for t in left & BANK[best][1])
        left -= BANK[best][1]
    return held


def containment(bag: set[str], idf: dict[str, float], rest: float) -> dict[str, float]:
    """Best TF-IDF containment of a passage by label, of those that reach it by one exemplar or by JOINED of them; ``rest`` weighs a term not counted."""
    weight = {t: idf.get(t, rest) for t in bag}
    whole = sum(weight.values()) or 1.0
    out: dict[str, float] = {}
    for label, ids in retrieve(bag).items():
        best = max((sum(weight[t] for t in bag & BANK[i][1]) / whole for i in ids), default=0.0)
        most = sum(weight[t] for t in bag & LABELS[label]) / whole  # all exemplars of a label together have no more
        wide = cover(bag, label, weight) / whole if best < CONTAINMENT and most >= TOGETHER else 0.0
        if best >= CONTAINMENT or wide >= TOGETHER:
            out[label] = max(best, wide)
    return out


def judge_line(line: str, idf: dict[str, float], rest: float) -> list[tuple[str, str]]:
    """(label, sentence) of the sentences of a line that lie in a window of residue or furniture."""
    out: dict[str, str] = {}
    for w in windows(line):
        found = containment(terms(w), idf, rest)
        if found:
            # residue outweighs the furniture it may also resemble
            label = max(found, key=lambda k: (k != "furniture", found[k]))
            for s in _SENTENCE.split(w):
                if s.strip() and out.get(s.strip(), "furniture") == "furniture":
                    out[s.strip()] = label
    if all(v == "furniture" for v in out.values()) and is_furniture(line, terms(line)):
        return [("furniture", line)]
    return [(out[s.strip()], s.strip()) for s in _SENTENCE.split(line) if s.strip() in out]


def _judge(n_docs: int):
    names = ["doc_id", "label", "coverage", "variables"]

    def run(batches):
        for b in batches:
            rows = []
            for i, body, var, cands, df in zip(*(c.to_pylist() for c in b.columns)):
                idf = {t: math.log((n_docs + 1) / (n + 1)) + 0.1 for t, n in df or ()}
                rest = math.log(n_docs + 1) + 0.1
                by: Counter = Counter()
                for c in cands or []:
                    for label, part in judge_line(c["s"], idf, rest):
                        by[label] += size(part) * c["n"]
                base = max(1, body - by["furniture"])
                residue = {k: v / base for k, v in by.items() if k != "furniture"}
                cover = sum(residue.values())
                label = max(residue, key=lambda k: (residue[k], k)) if cover >= COVERAGE else ("template" if var else None)
                if label:
                    rows.append((i, label, round(cover, 6) if label != "template" else 1.0, var or []))
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label (error, script, filler or template), coverage and variables of the documents to exclude.

    The whole text of every document is read; document frequencies are counted
    over all of them, in parts first, and joined to the terms of candidate passages only. ``coverage`` is
    the share of the text that is residue, and for ``template`` that of the slot. Page furniture does not count as text. NULL, empty, blank and
    merely odd texts are no residue; repeated rows come out repeated.
    """
    src = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, body long, variables array<string>, cands array<struct<s: string, n: long>>, terms array<string>, term string, n long"
    seen = cut(src.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()), "residue")
    df = seen.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    n_docs = seen.filter("term = ''").agg(F.sum("n")).first()[0] or 0
    rows = seen.filter("term is null").select("row", "doc_id", "body", "variables", "cands")
    met = cut(seen.filter("term is null").select("row", F.explode("terms").alias("term")), "terms")
    weights = hot_join(met, df, ["term"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))  # the terms of one document
    judged = rows.join(weights, "row", "left").select("doc_id", "body", "variables", "cands", "df")
    return judged.mapInArrow(_judge(n_docs), "doc_id long, label string, coverage double, variables array<string>")
