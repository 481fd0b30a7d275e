"""Defects of answers in instruction and preference data (batch functions over lists of texts).

Each answer gets at most one defect, the first that holds:

``empty``           nothing but blanks, marks, markup or a word for "no value"
``copy``            nothing but the question: its words are covered by walking the suffix automaton of the question
``refusal``         a sentence that declines: a denial found by an automaton (Aho-Corasick), then states over classes of words
``truncated``       an open delimiter on the stack, a bare number or bullet at the end, or a last sentence without its end
``other_language``  the votes of common words name another language than those of the question

A missing (null or blank) question leaves an answer without a standard to be
judged by; such pairs get no defect.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import ahocorasick

from lontar.llm.normal import plain, plain_words

DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")

#: Words that stand for a missing value.
NO_VALUE = frozenset("none null nil nan na undefined empty kosong".split()) | {"n a", "tidak ada", "no answer", "no value"}

#: Classes of words of which sentences that decline are made, in English, Indonesian, Malay, Javanese and Sundanese (lower case).
#: The speaker.
SELF = frozenset("i me my we our saya aku kami kula kulo dalem abdi kuring mimin".split())
#: Denials, and what they deny; every denial before every one of its language is a phrase of the class ``unable``.
DENIED = (
    ("can t | cannot | can not | could not | couldn t | won t | will not | would not | wouldn t | unable | not able | not allowed | not permitted | not authorised | not authorized | not willing | not going | not prepared | not comfortable | not in a position | rather not", ""),
    ("tidak | tak | tiada | nggak | enggak | gak | ga | tdk | belum", "bisa | dapat | boleh | mampu | sanggup | mau | bersedia | berkenan | diizinkan | diperkenankan | dibenarkan | dibolehkan | diperbolehkan | berani | berhak | akan"),
    ("ora | mboten | boten | ndak", "bisa | isa | iso | saged | oleh | angsal | kena | gelem | purun | kersa | diidini | diidinake | sanggup | bakal | kuwawa"),
    ("teu | henteu | moal | teu acan", "bisa | tiasa | meunang | kenging | diidinan | diijinkeun | daék | daek | hayang | sanggup | iasa | wasa"),
)
#: Verbs that decline by themselves.
DECLINE = frozenset("decline refuse menolak enggan keberatan nolak emoh embung alim wegah".split())
#: A choice against an answer, before a bare denial.
CHOOSE = frozenset("choose prefer chose memilih milih pilih".split())
DENY = frozenset("not tidak tak ora mboten teu henteu".split())
#: What is beyond the speaker.
BEYOND = frozenset("beyond outside luar ngluwihi melebihi ngaleuwihan ngleuwihan".split())
ABILITY = frozenset("ability abilities capability capabilities scope able remit authority kemampuan kapasitas wewenang batas kewenangan kebolehan kabisan kabisanku kasagedan kasagedanku kamampuh kabisa pangaweruh".split())
#: What is declined, in forms with the speaker as the subject, and in passive forms.
ACT = frozenset(
    """help assist answer answers respond reply comply do provide give fulfil fulfill continue support engage offer share complete generate produce proceed discuss advise oblige
    membantu bantu menjawab jawab jawaban memenuhi penuhi melayani layani memberikan berikan memberi memproses proses menanggapi tanggapi meladeni mengabulkan kabulkan menuruti turuti
    melakukan lakukan melanjutkan lanjutkan menyanggupi sanggupi mengerjakan kerjakan jawapan menunaikan tunaikan menolong tolong
    mangsuli wangsulan mbantu ngewangi nulungi maringi menehi nyukani nglayani nindakake njawab nuruti nyembadani nyagahi
    ngajawab mantuan ngabantu mere méré masihan nyumponan ngalayanan ngawaler waleran nulungan nedunan ngalaksanakeun""".split()
)
PASSIVE = frozenset(
    """answered fulfilled processed provided completed honoured honored granted done dipenuhi dijawab dilayani diproses diberikan dikabulkan dilakukan dilanjutkan ditunaikan
    diwangsuli dijawabi dilayani ditindakake disembadani dijawab dicumponan dilayanan diwaler""".split()
)
REQUEST = frozenset("request requests question questions permintaan pertanyaan soalan permohonan panjaluk panyuwun pitakon pitakonan pitakenan paménta pamenta pananya patarosan pamundut".split())
#: Words within which the parts of such a sentence follow each other.
REACH = 7

#: Stems of requests whose answer is meant to be in another language.
_TRANSLATE = re.compile(r"translat|terjemah|tarjamah|alih ?bahasa|jarwak|pertal|into (?:english|indonesian|malay|javanese|sundanese)|(?:bahasa|basa) (?:inggris|inggeris|indonesia|melayu|jawa|sunda)|in (?:english|indonesian|malay|javanese|sundanese)\b")

#: Words that an announcement ("You asked:") may add to a copied question.
ANNOUNCED = 5

_LETTER = re.compile(r"[^\W_]")
_TERMINAL = re.compile(r"[.!?。]+[\"'”’)\]*_»`]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.+|…)[\"'”’)\]*_»`]*$")
_BARE = re.compile(r"(?:^|\n)[ \t]*(?:\(?\d{1,3}[.):]?|[-*+•–—»▪]|\(?[a-zA-Z][.)])$")
_ENTRY = re.compile(r"[ \t]*(?:\(?\d{1,3}[.):]|[-*+•–—»▪]|\(?[a-zA-Z][.)])[ \t]+")
_INNER_END = re.compile(r"[.!?][\"'”’)]*\s+\S")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}, {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_DELIMITER = re.compile(r"[()\[\]{}“”«»]")
#: Words of a last line without an end mark that may still be a complete short answer or list entry.
SHORT_LINE = 6


def voters(seen: dict[str, Counter], texts: Counter | None = None, least: int = 3, purity: float = 0.9) -> dict[str, str]:
    """Words that vote for a language: in ``least`` of its texts, and nearly never in another's.

    ``texts`` are the numbers of texts by language, by which words are weighed where the languages' shares differ.
    """
    lexicon = {}
    for w, c in seen.items():
        rate = {k: n / texts[k] for k, n in c.items()} if texts else c
        top = max(rate, key=lambda k: (rate[k], k))
        if c[top] >= least and rate[top] >= purity * sum(rate.values()):
            lexicon[w] = top
    return lexicon


def sample_words(samples: list[tuple[str, str]]) -> Counter:
    """In how many (language, text) samples of a language group each word stands: keys (word, group).

    Indonesian and Malay are one group (``id``), as they aren't held against each other.
    """
    found: Counter = Counter()
    for language, text in samples:
        found.update((w, "id" if language == "ms" else language) for w in set(plain_words(text)) if not w.isdigit())
    return found


def language_votes(samples: list[tuple[str, str]]) -> dict[str, str]:
    """Words that vote for a language group: common in its samples and nearly absent from the others'."""
    seen: dict[str, Counter] = {}
    for (w, language), n in sample_words(samples).items():
        seen.setdefault(w, Counter())[language] = n
    return voters(seen)


def request_words(pairs: list[tuple[str | None, str | None]], lexicon: dict[str, str]) -> Counter:
    """In how many questions each word goes with an answer of each language: keys (word, language), ('', language) for all questions.

    Questions and requests have words that running text seldom holds, so the samples don't
    teach them; the answers, whose language the samples do teach, stand for the question's.
    Requests for a translation teach nothing.
    """
    judge, found = Judge(lexicon), Counter()
    for question, answer in pairs:
        low = plain(question or "")
        language = judge.clear(plain_words(answer or ""), lexicon)
        if low and language and not _TRANSLATE.search(low):
            found.update((w, language) for w in {"", *plain_words(low)} if not w.isdigit())
    return found


class WordAutomaton:
    """Suffix automaton of a sequence of words: knows every run of consecutive words of it."""

    __slots__ = ("link", "longest", "step")

    def __init__(self, words: list[str]) -> None:
        step: list[dict[str, int]] = [{}]
        link, longest = [-1], [0]
        last = 0
        for w in words:
            here = len(step)
            step.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and w not in step[at]:
                step[at][w] = here
                at = link[at]
            if at >= 0:
                to = step[at][w]
                if longest[to] == longest[at] + 1:
                    link[here] = to
                else:
                    twin = len(step)
                    step.append(dict(step[to]))
                    longest.append(longest[at] + 1)
                    link.append(link[to])
                    while at >= 0 and step[at].get(w) == to:
                        step[at][w] = twin
                        at = link[at]
                    link[to] = link[here] = twin
            last = here
        self.step, self.link, self.longest = step, link, longest

    def matches(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run of the automaton's words that ends with it."""
        step, link, longest = self.step, self.link, self.longest
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in step[at]:
                at = link[at]
                n = longest[at]
            if w in step[at]:
                at = step[at][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def copied(question: list[str], answer: list[str], automaton: WordAutomaton | None = None) -> bool:
    """Whether the answer is the question, once or more, and but a few words of announcement."""
    if not question or len(answer) < len(question) or len(set(answer) - set(question)) > ANNOUNCED:
        return False
    runs = (automaton or WordAutomaton(question)).matches(answer)
    if max(runs) < len(question):
        return False
    least = min(len(question), 3)
    covered, until = 0, len(runs)
    i = len(runs) - 1
    while i >= 0:
        if runs[i] >= least:
            until = i - runs[i]
            covered += runs[i]
            i = until
        else:
            i -= 1
    return len(answer) - covered <= ANNOUNCED


def open_delimiters(text: str) -> bool:
    """Whether brackets stay open at the end (a stack), code fences count by pairs."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for c in _DELIMITER.findall(text):
        if c in _OPEN:
            stack.append(c)
        elif stack and stack[-1] == _CLOSE[c]:
            stack.pop()
    return bool(stack)


def truncated(answer: str) -> bool:
    text = answer.rstrip()
    if "```" in text:
        return text.count("```") % 2 == 1
    if _BARE.search(text) and "\n" in text:
        return True
    if _ELLIPSIS.search(text):
        return True
    if _DELIMITER.search(text) and open_delimiters(text):
        return True
    if _TERMINAL.search(text):
        return False
    if text[-1:] in ",;:-–—(" and len(text.split()) > 2:
        return True
    lines = [s for s in text.split("\n") if s.strip()]
    last = _ENTRY.sub("", lines[-1])
    if len(last.split()) > SHORT_LINE or _INNER_END.search(last):
        return True
    return any(_TERMINAL.search(s.rstrip()) and len(s.split()) > SHORT_LINE for s in lines[:-1])


def _phrases() -> dict[str, str]:
    """The phrases that open a refusal, with their class."""
    of = lambda text: [p.strip() for p in text.split("|")]
    unable = [f"{a} {b}".strip() for denials, denied in DENIED for a in of(denials) for b in of(denied)]
    return {p: "unable" for p in unable} | {w: "decline" for w in DECLINE} | {w: "choose" for w in CHOOSE} | {w: "beyond" for w in BEYOND}


_SENTENCE = re.compile(r"[.!?;\n\r]+")


def declines(words: list[str], phrases: dict[str, str]) -> bool:
    """Whether a sentence declines to answer or to help.

    The states: a denial of ability or will, then what is denied, within ``REACH`` words, said by the speaker, or of the request
    in the passive, or by a sentence that begins with the denial; a verb that declines, said by the speaker, of the request, before what is declined
    or the end; a choice not to act; a request beyond the speaker's ability.
    """
    longest = max(p.count(" ") for p in phrases) + 1
    for i in range(len(words)):
        for n in range(min(longest, len(words) - i), 0, -1):
            kind = phrases.get(" ".join(words[i : i + n]))
            if kind is None:
                continue
            before, after = words[max(0, i - REACH) : i], words[i + n : i + n + REACH]
            near = SELF.intersection(before) or SELF.intersection(after)
            acts = ACT.intersection(after)
            if kind == "unable" and (acts and (near or i <= 1) or PASSIVE.intersection(after) and REQUEST.intersection(before)):
                return True
            if kind == "decline" and SELF.intersection(before[-4:]) and (acts or REQUEST.intersection(words) or len(after) <= 1):
                return True
            if kind == "choose" and near and any(w in DENY and ACT.intersection(after[k + 1 : k + 4]) for k, w in enumerate(after)):
                return True
            if kind == "beyond" and any(w in ABILITY and (w.endswith("ku") or SELF.intersection(after) or REQUEST.intersection(before)) for w in after[:4]):
                return True
            break
    return False


class Judge:
    """Holds the automaton and the lexicons of answers and of questions; ``defect`` judges one answer."""

    def __init__(self, lexicon: dict[str, str], asked: dict[str, str] | None = None) -> None:
        self.lexicon = lexicon
        self.asked = lexicon if asked is None else asked
        self.phrases = _phrases()
        self.openings = ahocorasick.Automaton()
        for phrase in self.phrases:
            self.openings.add_word(f" {phrase} ", phrase)
        self.openings.make_automaton()

    def refusal(self, words: list[str], answer: str) -> bool:
        """Whether any sentence of the answer declines; sentences are looked at only where a phrase opens one."""
        if next(self.openings.iter(f" {' '.join(words)} "), None) is None:
            return False
        return any(declines(plain_words(s), self.phrases) for s in _SENTENCE.split(plain(answer)))

    @staticmethod
    def votes(words: list[str], lexicon: dict[str, str]) -> Counter:
        votes = Counter(map(lexicon.get, words))
        votes.pop(None, None)
        return votes

    def clear(self, words: list[str], lexicon: dict[str, str]) -> str:
        """The language with at least two votes and twice those of any other; '' where there is none."""
        top = self.votes(words, lexicon).most_common(2)
        return top[0][0] if top and top[0][1] >= 2 and (len(top) == 1 or top[0][1] >= 2 * top[1][1]) else ""

    def question(self, text: str | None) -> tuple[list[str], str, bool]:
        """Words of the question, its language ('' where unclear), whether it asks for another language."""
        low = plain(text or "")
        words = plain_words(low)
        return words, self.clear(words, self.asked), _TRANSLATE.search(low) is not None

    def defect(self, question: tuple[list[str], str, bool], answer: str | None) -> str | None:
        asked, language, translate = question
        if not asked:
            return None
        words = plain_words(answer or "")
        if not words or len(words) <= 3 and " ".join(words) in NO_VALUE:
            return "empty"
        if copied(asked, words):
            return "copy"
        if self.refusal(words, answer):
            return "refusal"
        text = html.unescape(answer) if "&" in answer else answer
        if truncated(text):
            return "truncated"
        if language and not translate and "```" not in text:
            votes = self.votes(words, self.lexicon)
            top = votes.most_common(1)
            if top and top[0][0] != language and top[0][1] >= 2 and top[0][1] >= 5 * votes.get(language, 0):
                return "other_language"
        return None
