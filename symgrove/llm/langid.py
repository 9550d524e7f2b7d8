"""Language of short texts by naive Bayes over character n-grams.

The model is fitted, in each process, on the labelled sentences below: a bounded
sample of some thirty sentences a language. N-grams of one to four characters
are taken within words, so a word's evidence is computed once and kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja", "ru")
SIZES = (1, 2, 3, 4)
KEPT_WORDS = 100_000

#: The labelled sample.
SAMPLE = {
    "en": """The code was generated by a tool and will be generated by it again. This function reads the whole file and returns the number of lines that were found. If the value is missing, an error is raised and nothing will be changed.
You should not call this more than once, because the lock is held by another thread. We use a small table here so that the lookup stays fast on large inputs.
The caller owns the memory and must free it when it is no longer needed. All names are sorted before they are written to the output. It takes two passes over the list to find which of them have changed since the last run.
Please try again later, or contact the administrator of your system. Could not connect to the server while opening a new session. There are no more items left to show. Use the default settings unless you know what you are doing.
Each entry has its own key and can be removed without any effect on the others. See the manual for more details about how this works. Copyright by the authors, all rights reserved. Licensed under the terms of the agreement. Do not edit this by hand.
Keep both values in step with each other. What happens when several users write at the same time? Only the first one wins and the rest would wait for it. Cannot find the requested page, it may have been moved. Unexpected end of input after reading from the stream. Giving up after too many attempts. The request was rejected with an unknown status. Failed to parse number near line. Since every worker has been started under its own name, they are able to share this cache as long as it is warm. Splits the string at the given position and keeps what comes before. Checks whether the user may access that item, otherwise it fails early. Stop when done. Wait until ready. Was not found. Is already in use. Run the tool first.""",
    "de": """Diese Funktion liest die ganze Datei und gibt die Anzahl der gefundenen Zeilen zurück. Wenn der Wert fehlt, wird ein Fehler ausgelöst und nichts verändert.
Man sollte sie nicht mehr als einmal aufrufen, weil die Sperre von einem anderen Faden gehalten wird. Wir verwenden hier eine kleine Tabelle, damit die Suche auch bei großen Eingaben schnell bleibt.
Der Aufrufer besitzt den Speicher und muss ihn freigeben, sobald er nicht mehr gebraucht wird. Alle Namen werden sortiert, bevor sie in die Ausgabe geschrieben werden. Es sind zwei Durchläufe über die Liste nötig, um zu finden, was sich seit dem letzten Lauf geändert hat.
Bitte versuchen Sie es später noch einmal oder wenden Sie sich an den Verwalter Ihres Systems. Die Verbindung zum Server konnte nicht hergestellt werden. Es gibt keine weiteren Einträge. Nutze die Vorgaben, es sei denn, du weißt, was du tust.
Jeder Eintrag hat einen eigenen Schlüssel und kann ohne Wirkung auf die übrigen entfernt werden. Näheres dazu steht im Handbuch. Alle Rechte vorbehalten. Nicht von Hand ändern, diese Angaben wurden maschinell erzeugt.
Beide Werte müssen miteinander Schritt halten. Was geschieht, wenn mehrere Benutzer gleichzeitig schreiben? Nur der erste gewinnt und die anderen warten auf ihn. Die Seite wurde nicht gefunden, sie ist vielleicht verschoben worden. Unerwartetes Ende der Eingabe beim Lesen. Nach zu vielen Versuchen wird abgebrochen. Der Dienst ist zurzeit nicht verfügbar oder noch belegt. Kann nicht geöffnet werden, da sie bereits gesperrt ist. Prüft, ob der Nutzer darauf zugreifen darf, und bricht sonst früh ab. Hängt das Ergebnis hinten an und liefert es zurück. Dabei bleibt die Reihenfolge erhalten. Der Zeiger darf nicht leer sein. Läuft vollständig im Hintergrund. Das Verzeichnis ist nicht mehr vorhanden. Eine Grenze gilt nur für den zweiten Fall und nicht für das erste.""",
    "fr": """Cette fonction lit tout le fichier et renvoie le nombre de lignes trouvées. Si la valeur est absente, une erreur est levée et rien n'est modifié.
Il ne faut pas l'appeler plus d'une fois, car le verrou est tenu par un autre fil. Nous utilisons ici une petite table afin que la recherche reste rapide sur de grandes entrées.
L'appelant possède la mémoire et doit la libérer dès qu'elle n'est plus utile. Tous les noms sont triés avant d'être écrits dans la sortie. Deux passages sur la liste sont nécessaires pour trouver ce qui a changé depuis la dernière exécution.
Veuillez réessayer plus tard ou contacter l'administrateur de votre système. Impossible de se connecter au serveur pendant l'ouverture d'une nouvelle session. Il n'y a plus d'éléments à afficher. Utilisez les réglages par défaut, sauf si vous savez ce que vous faites.
Chaque entrée a sa propre clé et peut être retirée sans effet sur les autres. Voir le manuel pour plus de détails. Tous droits réservés. Ne pas modifier à la main, ces données sont produites automatiquement.
Les deux valeurs doivent rester en accord. Que se passe-t-il quand plusieurs utilisateurs écrivent en même temps ? Seul le premier gagne et les autres l'attendent. La page demandée est introuvable, elle a peut-être été déplacée. Fin inattendue de l'entrée après lecture du flux. Abandon après trop d'essais sur ce point. Le service est déjà utilisé ou n'existe pas encore. Vérifie que l'utilisateur peut accéder à cet élément, sinon échoue aussitôt. Ajoute le résultat à la fin et le rend. L'ordre est conservé dans tous les cas. Le pointeur ne doit pas être vide, mais il peut être nul à tout moment. Une limite s'applique seulement au second cas. Les anciennes versions étaient trop lentes ; il vaut mieux les éviter jusqu'à demain. Quand c'est fait, le dossier est vidé puis fermé.""",
    "es": """Esta función lee todo el archivo y devuelve el número de líneas encontradas. Si falta el valor, se produce un error y no se cambia nada.
No se debe llamar más de una vez, porque otro hilo mantiene el bloqueo. Aquí usamos una tabla pequeña para que la búsqueda siga siendo rápida con entradas grandes.
Quien llama es dueño de la memoria y tiene que liberarla cuando ya no haga falta. Todos los nombres se ordenan antes de escribirlos en la salida. Hacen falta dos pasadas sobre la lista para saber qué ha cambiado desde la última vez.
Vuelva a intentarlo más tarde o póngase en contacto con el administrador de su sistema. No se pudo conectar con el servidor al abrir una sesión nueva. No hay más elementos que mostrar. Use los ajustes por defecto, salvo que sepa lo que hace.
Cada entrada tiene su propia clave y puede quitarse sin efecto sobre las demás. Véase el manual para más detalles. Todos los derechos reservados. No editar a mano, estos datos fueron generados de forma automática.
Los dos valores deben ir a la par. ¿Qué pasa cuando varios usuarios escriben al mismo tiempo? Solo gana el primero y los otros lo esperan. La página solicitada no existe, quizá fue movida. Fin inesperado de la entrada después de leer el flujo. Se abandona después de demasiados intentos. El servicio todavía está en uso o no existe. Comprueba si el usuario puede acceder a ese elemento y, en caso contrario, falla pronto. Añade el resultado al final y lo devuelve. El orden se conserva en todos los casos. El puntero no puede estar vacío, pero puede ser nulo en cualquier momento. Un límite se aplica solamente al segundo caso. Las versiones anteriores eran lentas; conviene evitarlas hasta mañana. Cuando esté hecho, la carpeta queda vacía y luego cerrada.""",
    "ru": """Эта функция читает весь файл и возвращает число найденных строк. Если значение отсутствует, возникает ошибка и ничего не меняется. Не следует вызывать её больше одного раза, потому что блокировку держит другой поток.
Вызывающий код владеет памятью и должен освободить её, когда она больше не нужна. Все имена сортируются перед записью. Пожалуйста, повторите попытку позже или обратитесь к администратору вашей системы. Не удалось подключиться к серверу при открытии нового сеанса. Страница не найдена, возможно, она была перемещена. У каждой записи свой ключ, и её можно удалить без влияния на остальные. Все права защищены. Не изменяйте вручную. После многих попыток данные уже не читаются. Проверяет, может ли пользователь получить доступ. Порядок сохраняется во всех случаях. Ограничение действует только на второй случай, но не на первый.""",
    "zh": """该函数读取整个文件并返回找到的行数。如果缺少该值，则会引发错误，并且不会更改任何内容。不应多次调用，因为锁由另一个线程持有。这里我们使用一个小表，使查找在大量输入时仍然很快。
调用者拥有内存，在不再需要时必须释放。所有名称在写入输出之前都会排序。请稍后再试，或联系系统管理员。无法连接到服务器，打开新会话失败。没有更多项目可以显示。每个条目都有自己的键，可以删除而不影响其他条目。更多细节请参阅手册。版权所有，保留所有权利。请勿手工修改，这些数据是自动生成的。当多个用户同时写入时会发生什么？只有第一个成功，其余的等待。页面不存在，可能已被移动。尝试太多次之后放弃处理。服务正在使用，不能打开。检查用户是否可以访问该项，否则提前失败。将结果追加到末尾并返回。在任何情况下都保持顺序。默认限制只作用于第二种情况。旧版本太慢，升级之后需要重新建立。从上个版本开始，目录被清空然后关闭。""",
    "ja": """この関数はファイル全体を読み込み、見つかった行の数を返します。値がない場合はエラーになり、何も変更されません。ロックは別のスレッドが保持しているため、二回以上呼び出さないでください。ここでは小さな表を使い、大きな入力でも検索が速くなるようにしています。
呼び出し側はメモリを所有し、不要になったら解放しなければなりません。すべての名前は出力に書き込む前に並べ替えられます。後でもう一度お試しいただくか、システムの管理者にお問い合わせください。サーバーに接続できませんでした。表示する項目はもうありません。各項目には独自のキーがあり、他に影響を与えずに削除できます。詳しくは手引きをご覧ください。無断転載を禁じます。手で編集しないでください。ページが見つかりません、移動された可能性があります。何度も試しましたが読み込めません。サービスは現在使用中です。利用者がその項目にアクセスできるかを確認し、できなければすぐに失敗します。結果を末尾に追加して返す。順序はどの場合でも保たれます。以前の版では遅かった。既定の上限は二番目の場合だけに適用され、最初には影響しない。""",
}

#: Samples of neighbours of these languages, which a text is compared with before it is given to one of them.
OTHERS = {
    "it": """Questa funzione legge tutto il file e restituisce il numero di righe trovate. Se il valore manca, viene generato un errore e nulla sarà modificato. Non bisogna chiamarla più di una volta, perché il blocco è tenuto da un altro processo. Qui usiamo una piccola tabella, così la ricerca resta veloce anche con dati molto grandi. Il chiamante possiede la memoria e deve liberarla quando non serve più. Tutti i nomi vengono ordinati prima di essere scritti. Si prega di riprovare più tardi o di contattare l'amministratore del sistema. Impossibile connettersi al server durante l'apertura della sessione. Non ci sono altri elementi da mostrare. Ogni voce ha la propria chiave e può essere rimossa senza effetti sulle altre. Gli utenti che scrivono nello stesso momento devono aspettare la fine della prima scrittura. Questi dati sono stati generati dalla macchina e non vanno cambiati a mano.""",
    "nl": """Deze functie leest het hele bestand en geeft het aantal gevonden regels terug. Als de waarde ontbreekt, wordt er een fout gemeld en verandert er niets. Je mag haar niet vaker dan één keer aanroepen, omdat de vergrendeling door een andere draad wordt vastgehouden. We gebruiken hier een kleine tabel, zodat het zoeken ook bij grote invoer snel blijft. De aanroeper bezit het geheugen en moet het vrijgeven zodra het niet meer nodig is. Alle namen worden gesorteerd voordat ze naar de uitvoer worden geschreven. Probeer het later opnieuw of neem contact op met de beheerder van het systeem. Er kon geen verbinding met de server worden gemaakt. Er zijn geen andere onderdelen meer om te tonen. Elk item heeft zijn eigen sleutel en kan zonder gevolgen voor de andere worden verwijderd. Deze gegevens zijn door een machine gemaakt en mogen niet met de hand worden gewijzigd. Het is niet mogelijk om dit nu te doen.""",
    "pt": """Esta função lê o arquivo inteiro e devolve o número de linhas encontradas. Se o valor não existir, ocorre um erro e nada será alterado. Ela não deve ser chamada mais de uma vez, porque o bloqueio está com outra linha de execução. Aqui usamos uma tabela pequena, para que a busca continue rápida com entradas grandes. Quem chama é dono da memória e tem de a libertar quando já não for necessária. Todos os nomes são ordenados antes de serem escritos na saída. Por favor, tente novamente mais tarde ou fale com o administrador do sistema. Não foi possível ligar ao servidor ao abrir a sessão. Não há mais itens para mostrar. Cada entrada tem a sua própria chave e pode ser removida sem efeito nas outras. Os usuários que escrevem ao mesmo tempo têm que esperar até a primeira escrita acabar. Estes dados foram gerados pela máquina e não devem ser mudados à mão.""",
    "pl": """Ta funkcja czyta cały plik i zwraca liczbę znalezionych wierszy. Jeśli brakuje wartości, zgłaszany jest błąd i nic się nie zmienia. Nie należy jej wywoływać więcej niż raz, ponieważ blokadę trzyma inny wątek. Używamy tu małej tabeli, żeby wyszukiwanie było szybkie także przy dużych danych. Wszystkie nazwy są sortowane przed zapisem. Proszę spróbować później albo skontaktować się z administratorem. Nie można połączyć się z serwerem. Każdy wpis ma własny klucz i może zostać usunięty bez wpływu na pozostałe.""",
    "uk": """Ця функція читає весь файл і повертає кількість знайдених рядків. Якщо значення відсутнє, виникає помилка і нічого не змінюється. Її не слід викликати більше одного разу, тому що блокування тримає інший потік. Тут ми використовуємо невелику таблицю, щоб пошук залишався швидким. Усі імена сортуються перед записом. Будь ласка, спробуйте пізніше або зверніться до адміністратора. Кожен запис має власний ключ і може бути вилучений без впливу на інші.""",
}
#: A text goes to none of LANGUAGES if one of OTHERS is likelier by this much a letter, and by MARGIN in all; or if this share of its letters stands in no sample.
PER_LETTER, MARGIN, STRANGE = 0.2, 6.0, 0.5

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_WIDE = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿]")


def _grams(word: str) -> list[str]:
    if _WIDE.search(word):
        return [word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)]
    w = f" {word} "
    return [w[i : i + n] for n in SIZES for i in range(len(w) - n + 1) if w[i : i + n] != " "]


class NaiveBayes:
    """Multinomial naive Bayes over the n-grams of words, with add-alpha smoothing; the classes are equally likely."""

    def __init__(self, sample: dict[str, str], alpha: float = 0.3):
        counts = {k: Counter(g for w in _TOKEN.findall(t.lower()) for g in _grams(w)) for k, t in sample.items()}
        self.classes = tuple(sample)
        grams = set().union(*counts.values())
        totals = [sum(counts[k].values()) + alpha * (len(grams) + 1) for k in self.classes]
        self.unseen = tuple(math.log(alpha / t) for t in totals)
        self.weight = {g: tuple(math.log((counts[k][g] + alpha) / t) for k, t in zip(self.classes, totals)) for g in grams}
        self.words: dict[str, tuple[float, ...]] = {}

    def _word(self, w: str) -> tuple[float, ...]:
        v = self.words.get(w)
        if v is None:
            v = tuple(map(sum, zip(*(self.weight.get(g, self.unseen) for g in _grams(w)))))
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[w] = v
        return v

    def scores(self, text: str) -> dict[str, float] | None:
        """Logarithm of the likelihood by class; None for a text without letters."""
        words = [x for w in _TOKEN.findall(text.lower()) for x in (list(w[i : i + 2] for i in range(0, len(w), 2)) if _WIDE.search(w) else [w])]
        return dict(zip(self.classes, (sum(v) for v in zip(*map(self._word, words))))) if words else None

    def known(self, text: str) -> float:
        """Share of the letters that stand in some sample."""
        letters = [c for c in text.lower() if c.isalpha()]
        return sum(c in self.weight or bool(_WIDE.match(c)) for c in letters) / max(1, len(letters))


_model: list[NaiveBayes] = []


def language(text: str) -> str | None:
    """Language of a text, one of LANGUAGES; on a tie the first. None without letters, in other scripts, and for a text that is clearly of a neighbouring language."""
    if not _model:
        _model.append(NaiveBayes(SAMPLE | OTHERS))
    score = _model[0].scores(text)
    if score is None or not text.isascii() and _model[0].known(text) < STRANGE:
        return None
    own, other = max(LANGUAGES, key=score.__getitem__), max(OTHERS, key=score.__getitem__)
    lead = score[other] - score[own]
    return None if lead > max(MARGIN, PER_LETTER * len(text)) else own
