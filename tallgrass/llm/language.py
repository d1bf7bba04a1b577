"""Share of a text that is in another language than a reference text, by a character n-gram model.

Every word is scored for every language by the hashed n-grams of its bytes (two to four, with marks
for the beginning and end of the word, and the word as a whole) under a naive Bayes model.  The model
starts from half a page of general prose and frequent words of each language, and learns further from
sentences of a sample of the data that it is sure of (``Tongue.refine``), so that names and terms of
the data find their language without being listed; no language gains by having more text.  Sentences vote: each takes its
likeliest language, and counts with its bytes; sentences without evidence, such as bare formulas, do
not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallgrass.llm import arrowtext as at

#: General prose and frequent words of each language: what the model is trained on.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. A circle touches the line, and a tank is filled with litres of water in one minute. Compute the quantity that is required, simplify the fraction as far as possible, and compare both results. Several people travel to different places, and each of them carries some of the goods. The table contains the numbers, the picture shows the situation, and the reason is simple. We first write down what is given, then we look for the value that makes both sides equal. This gives the answer, so there is only one solution left. If the number were greater, the sum would be too large. the of and is to in that it for on are with as by this be from at or which we have not so no if all one two can let then than first only any each both its has was there where when find value show gives hence thus therefore answer none these say yes but true false increasing decreasing infinite undefined positive negative always never neither terms equals how many does will their after before between constant convergent converges absolutely diverges parallel perpendicular possible impossible odd even prime integer rational ellipse circle isosceles infinity minus infinite solutions fraction angle degrees clockwise domain range matrix vector function factor multiple remainder decimal percent probability median",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Wir schreiben zuerst auf, was gegeben ist, dann suchen wir den Wert, für den beide Seiten gleich sind. Das ergibt die Antwort, also gibt es nur eine Lösung. Wäre die Zahl größer, so wäre die Summe zu groß. der die das und wie groß welche ist nicht ein eine einen wir mit auf den dem des im zu von für wird werden sind auch als bei oder aber nach aus wenn dann man sich keine kein immer zwei drei alle jede nur noch durch beide gleich kleiner wahr falsch unendlich viele niemals weder noch wieviel zwischen vorher",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nous écrivons d'abord ce qui est donné, puis nous cherchons la valeur pour laquelle les deux membres sont égaux. Cela donne la réponse, il n'y a donc qu'une solution. Si le nombre était plus grand, la somme serait trop grande. le la les quel quelle combien des du un une est et dans que qui pour sur par avec ne pas plus on nous vous il elle sont aux au ce cette ces donc alors aucune aucun toujours jamais deux trois tous vrai faux infini où ou entre même après avant environ exactement",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Primero escribimos lo que se da y después buscamos el valor para el que ambos lados son iguales. Esto da la respuesta, así que hay una sola solución. Si el número fuera mayor, la suma sería demasiado grande. el la los las vale qué cuál cuáles halla una unos es y en que por para con no se del al lo como más pero sus si son está este esta estos hay siempre nunca ninguna ninguno dos tres cuánto cada todos verdadero falso entre antes después infinitas exactamente menor",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Scriviamo ciò che è dato, dopo cerchiamo il valore per il quale i due membri sono uguali. Questo dà la risposta, quindi esiste una sola soluzione. Se il numero fosse maggiore, la somma sarebbe troppo grande. il la le lo gli quanto vale qual una è e di che per con non si del della dei delle nel nella sono come più ma anche questo questa quindi poi nessuna nessuno sempre mai due tre tutti vero falso infinite tra oppure circa prima minore ogni",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Primeiro escrevemos o que é dado, depois procuramos o valor para o qual os dois lados são iguais. Isto dá a resposta, portanto só há uma solução. o os as um uma é e em que não para com por se do da dos das no na mais como mas ao são também já ou quando muito nos só pelo pela até isso ela entre depois sem mesmo nenhuma sempre dois três verdadeiro falso nunca",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Eerst schrijven we op wat gegeven is, daarna zoeken we de waarde waarvoor beide kanten gelijk zijn. Dit geeft het antwoord, dus er is maar één oplossing. de het een en van is dat op te in voor met zijn niet aan er om ook als bij maar dan ze uit nog geen wel naar wij deze dit wordt altijd twee drie nooit waar onwaar",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Najpierw zapisujemy, co jest dane, potem szukamy wartości, dla której obie strony są równe. i w na nie się z do jest to że o jak po co ale od za czy przez dla tylko już jego są ma być oraz lub dwa trzy zawsze nigdy brak prawda fałsz",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Var och en har rätt till liv, frihet och personlig säkerhet. Först skriver vi upp vad som är givet, sedan söker vi värdet för vilket båda sidor är lika. och att det som en på är av för med till den har inte om ett men var sig så vi från eller när två tre alltid aldrig ingen sant falskt",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Сначала запишем, что дано, затем найдём значение, при котором обе части равны. Это и есть ответ, поэтому решение одно. и в не на что с по это как из для при если то нет всегда никогда два три сумма число верно неверно",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。首先写出已知条件，然后求使两边相等的值。这就是答案，所以只有一个解。的 是 在 不 了 有 和 这 中 大 为 上 个 我 以 要 他 时 来 用 们 没有 总是 两个 三 正确 错误 无限 多少",
}
LANGS = tuple(SEEDS)
BITS = 16
_SHIFT = np.uint64(64 - BITS)
#: Advantage over the second language, in nats, from which a sentence is decided.
DECIDED = 2.5
#: Advantage from which the model learns of a sentence or text, and the share of an n-gram that was not seen.
SURE, _FLOOR = 10.0, 2e-6
#: A whole word counts as so many of its n-grams.
WHOLE = 2
#: Overlapping n-grams tell the same thing several times.
SCALE = 0.25
_MARKED = np.frombuffer(b"\\</_", np.uint8)


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of words, and the word of each."""
    out, own = [], []
    size = end - start
    with np.errstate(over="ignore"):
        for k in (2, 3, 4):
            many = np.maximum(size - k + 1, 0)
            word = np.repeat(np.arange(len(start)), many)
            off = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
            a = start[word] + off
            edge = (off == 0) * np.uint64(1) + (a + k == end[word]) * np.uint64(2)
            out.append(at.mix(at.span_hash(data, a, a + k) ^ (edge + np.uint64(4 * k)) * np.uint64(0x9E3779B97F4A7C15)))
            own.append(word)
        whole = at.mix(at.span_hash(data, start, end) ^ np.uint64(0xA5A5))
        out += [whole] * WHOLE
        own += [np.arange(len(start))] * WHOLE
    return (np.concatenate(out) >> _SHIFT).astype(np.int64), np.concatenate(own)


class Tongue:
    """The n-gram model: a score of each n-gram for each language."""

    def __init__(self, texts: dict[str, str] = SEEDS) -> None:
        self.seed = np.zeros((1 << BITS, len(texts)))
        for k, text in enumerate(texts.values()):
            w = at.Words(*at.buffers(pa.array([text])))
            slot, _ = _grams(w.data, w.start[w.kind == 1], w.end[w.kind == 1])
            self.seed[:, k] = np.bincount(slot, minlength=1 << BITS)
        self._score(self.seed / self.seed.sum(axis=0))
        self._meet([])

    def _score(self, share: np.ndarray) -> None:
        table = np.log(share + _FLOOR)
        table -= table.mean(axis=1, keepdims=True)
        self.table = (table * SCALE).astype(np.float32)

    def refine(self, texts: pa.Array, rounds: int = 2) -> Tongue:
        """Learn further from texts: their sentences count for the text's language if it is sure, unless they are sure of another."""
        base = self.seed / self.seed.sum(axis=0)
        parts = [texts.slice(a, b - a) for a, b in at.blocks(texts)]
        for _ in range(rounds):
            more, blocks = np.zeros_like(self.seed), []
            for col in parts:
                s = sentences(col, self)
                w = s.words
                blocks.append(w)
                if not len(s.start):
                    continue
                top = np.sort(s.total(), axis=1)
                main = np.where(top[:, -1] - top[:, -2] >= SURE, s.total().argmax(axis=1), -1)[s.row]
                lang = np.where(s.margin >= SURE, s.score.argmax(axis=1), main)
                own = lang[np.searchsorted(s.start, w.start, side="right") - 1]
                i = np.flatnonzero((w.kind == 1) & (own >= 0) & (w.end - w.start > 1))
                _, first, many = np.unique(at.mix(w.hash[i] + own[i].astype(np.uint64)), return_index=True, return_counts=True)
                slot, word = _grams(w.data, w.start[i][first], w.end[i][first])
                np.add.at(more, (slot, own[i][first][word]), np.sqrt(many)[word])  # a frequent word says little new
            total = more.sum(axis=0)
            self._score(np.maximum(base, more / np.maximum(total, 1)))  # what it started from is not diluted by what it met
            self._meet(blocks)
        return self

    def words(self, w: at.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with evidence (of two letters, no commands or tags) and their scores by language."""
        marked = np.isin(w.data[np.maximum(w.start - 1, 0)], _MARKED) & (w.start > 0)
        some = np.flatnonzero((w.kind == 1) & (w.end - w.start > 1) & ~marked)
        place = self.met.find(w.hash[some])
        new = np.flatnonzero(place < 0)
        out = self.met_score[np.maximum(place, 0)]
        if len(new):
            _, first, back = np.unique(w.hash[some][new], return_index=True, return_inverse=True)
            out[new] = self._word_scores(w, some[new][first])[back]
        return some, out

    def _word_scores(self, w: at.Words, words: np.ndarray) -> np.ndarray:
        slot, own = _grams(w.data, w.start[words], w.end[words])
        order = np.argsort(own, kind="stable")
        return np.add.reduceat(self.table[slot[order]], np.searchsorted(own[order], np.arange(len(words))), axis=0) if len(words) else np.zeros((0, len(LANGS)), np.float32)

    def _meet(self, words: list[at.Words]) -> None:
        """Keep the scores of words that were met, so that they need no n-grams again."""
        h = np.concatenate([w.hash[w.kind == 1] for w in words]) if words else np.zeros(0, np.uint64)
        keys = np.unique(h)
        score, done = np.zeros((max(len(keys), 1), len(LANGS)), np.float32), np.zeros(len(keys), bool)
        for w in words:
            i = np.flatnonzero(w.kind == 1)
            k, first = np.unique(w.hash[i], return_index=True)
            at_ = np.searchsorted(keys, k)
            fresh = ~done[at_]
            score[at_[fresh]] = self._word_scores(w, i[first[fresh]])
            done[at_] = True
        self.met, self.met_score = at.Slots(keys), score


class Sentences:
    """Language of every sentence of a block of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: at.Words, tongue: Tongue):
        n, self.rows, self.words = len(data), len(off) - 1, words
        nxt = np.empty(n, np.uint8)
        nxt[:-1], nxt[-1:] = data[1:], 32
        blank = (nxt == 32) | ((nxt >= 9) & (nxt <= 13)) | (nxt == 34)
        stop = (data == 10) | (((data == 46) | (data == 33) | (data == 63)) & blank)
        cut = np.unique(np.concatenate([off, np.flatnonzero(stop) + 1]))
        self.start, end = cut[:-1], cut[1:]
        self.bytes = (end - self.start).astype(float)
        self.row = np.searchsorted(off, self.start, side="right") - 1
        ns = len(self.start)
        some, score = tongue.words(words)
        sent = np.searchsorted(self.start, words.start[some], side="right") - 1
        self.score = np.stack([np.bincount(sent, weights=score[:, k], minlength=ns) for k in range(len(LANGS))], axis=1).astype(float) if ns else np.zeros((0, len(LANGS)))
        top = np.partition(self.score, -2, axis=1)
        self.margin = top[:, -1] - top[:, -2]

    def total(self) -> np.ndarray:
        """Evidence of each text for each language."""
        return np.stack([np.bincount(self.row, weights=self.score[:, k], minlength=self.rows) for k in range(len(LANGS))], axis=1)

    def main(self) -> np.ndarray:
        """Language number of each text by its summed evidence, -1 without any."""
        s = self.total()
        top = np.sort(s, axis=1)
        return np.where(top[:, -1] - top[:, -2] >= DECIDED, s.argmax(axis=1), -1)

    def other(self, reference: np.ndarray) -> np.ndarray:
        """Share of each text's decided bytes in another language than ``reference[row]``.

        A sentence is decided if some other language is clearly ahead of the reference, or behind it;
        which of the others it is does not matter.  ``sure`` is then each text's evidence, from -1 to 1.
        """
        ns = len(self.start)
        ref = reference[self.row] if ns else np.zeros(0, np.int64)
        known = np.flatnonzero(ref >= 0)
        own = np.zeros(ns)
        rest = self.score.copy()
        own[known] = self.score[known, ref[known]]
        rest[known, ref[known]] = -np.inf
        ahead = rest.max(axis=1, initial=-np.inf) - own
        decided = (np.abs(ahead) >= DECIDED) & (ref >= 0)
        w = np.where(decided, self.bytes, 0)
        total = np.bincount(self.row, weights=w, minlength=self.rows)
        alien = np.bincount(self.row, weights=np.where(ahead > 0, w, 0), minlength=self.rows)
        self.sure = np.clip(np.bincount(self.row, weights=np.where(decided, ahead, 0), minlength=self.rows) / 10, -1, 1)
        return np.where(total > 0, alien / np.maximum(total, 1), 0.0)


def sentences(col: pa.Array, tongue: Tongue, words: at.Words | None = None) -> Sentences:
    """Sentences of a string array (``words``: its tokens, where they are known); marks beyond ASCII separate words."""
    data, off = at.buffers(col)
    if (data > 127).any():
        col = pc.replace_substring(col, "。", ". ")
        col = pc.replace_substring_regex(col, r"[\x{A0}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{2BFF}\x{3000}-\x{303F}\x{FF00}-\x{FF20}]", " ")
        data, off = at.buffers(col)
        words = None
    return Sentences(data, off, words or at.Words(data, off), tongue)
