"""Telling answers that decline to answer from sound ones, by word n-grams.

Method: a logistic model over the word n-grams (one to ORDER words) of a sentence, trained
here on sentences composed from general phrases of declining (English, German, French,
Spanish) and on sound answers, among them many that speak of what was not seen, could not
be measured or was declined by others. Words of the phrases are kept, all others are one
class, numbers another, so topics have no weight. The training set is fixed and bounded
(SENTENCES of each kind) and holds no text of any corpus. A response is a refusal if one of
its sentences is.

Null and blank texts are none; a score of just SURE counts as sound.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import regex

ORDER, SENTENCES, SEED = 3, 1400, 4
STEPS, RATE, DECAY, SURE = 400, 0.5, 5e-4, 1.0  # SURE: odds from which a sentence declines
_TOKEN = regex.compile(r"\p{N}[\p{N}.,]*|[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)*|[.!?;:,…]")
_CUT = regex.compile(r"(?<=[.!?…])\s+")

# Phrases to compose from; {x} stands for a topic, {a|b} for a choice.
DECLINING = (
    "{|Sorry, |I'm sorry, but |I am sorry, |Unfortunately, |Unfortunately |Regrettably, |I apologise, but |I apologize, but |I'm afraid |I am afraid that |Apologies, |Hmm. |Thank you for asking. |My apologies, but }{I|we} {cannot|can't|can not|won't|will not|could not|am unable to|am not able to|are unable to|am not allowed to|am not permitted to|must decline to|have to decline to|refuse to|decline to|would rather not|would prefer not to|don't want to|do not wish to} {answer {this|that|it|the question|this question|that question|questions about {x}}|help {|you }with {this|that|this request|that request|it}|provide {this|that|an answer|that information|an answer to this|any details}|say {|anything about {x}|anything on that|more}|comment on {this|that|the {x}|{x}}|discuss {this|that|{x}|the {x}}|give {advice on this topic|an opinion on {x}|an answer|any information|medical advice}|assist {with that|you|with this}|respond {|to this|to that}|determine this{| from the passages| from the context}|tell{| you}|speak about {x}|share {that|this|that information}|talk about {x}|judge this|go into that}{| at this time| here| right now|; please ask a specialist|. Please ask an expert|, please consult a professional}{.|}",
    "{|Sorry, |I'm afraid }I{'m| am} {unable to|not able to|not allowed to|not permitted to|unwilling to|not in a position to} {answer|help with|comment on|discuss|provide|determine|say anything about} {this|that|{x}|the {x}|this request|this topic}{.|}",
    "{|Unfortunately |Regrettably, |I'm afraid |Sorry, }{I|we}{ cannot| can't| can not|'m unable to|'m not able to|'m not allowed to| am not allowed to| won't} {comment on|discuss|say anything about|speak about} {the {x}|{x}|that|this topic}{.|}", "I {do not|don't} feel {comfortable|able} {discussing|answering|talking about|commenting on|sharing} {this|that|{x}|the {x} of {x}}{.|}", "{That|This} is {something|a question|one} {I|we} {cannot|can't|won't|am not able to} {assist with|help with|answer|discuss}{.|}", "{That|This} is not something I {am comfortable|feel comfortable|am happy|want to be} {answering|discussing|talking about|commenting on}{.|}", "I {have to|must|will|need to|would rather|'d rather|am going to} {pass on this {one|question}|leave this {one|question} open|leave the question open|skip this {one|question}|stop here|decline}{.|}",
    "I {don't|do not} {know|know the answer|know that|know the answer to this|know enough to say|have an answer|have that information|have any information on {x}|have enough information{| to say| to answer}|have access to that}{.|}", "I have no {idea|knowledge of {that|{x}}|information on {that|this|{x}}|answer to {that|this}|opinion on {that|{x}}}{.|}", "I have no knowledge of that and will leave {the|this} question open{.|}",
    "No answer {can be given|is possible|can be provided} {from|with|on} the {context|passages|information} {|provided|given}{.|}", "The {context|passage|text|document} {does not|doesn't} {mention|contain|cover|say anything about} {{x}|the answer|this}, {so|therefore|hence|and} I {cannot|can't} {tell|say|answer|help}{.|}", "The {context|information} {provided|given} is not {enough|sufficient} {to answer|for an answer|for me to answer}{.|}",
    "My {guidelines|instructions|rules|policy|principles} {do not|don't|does not} {allow|permit} me to {discuss|answer|comment on|talk about} {{x}|this|that}{|; please consult a professional}{.|}", "{It is|This is|That goes|Answering goes} against my {guidelines|instructions|rules|policy}{| to answer| to discuss {x}}{.|}", "As {an AI|a language model|an AI language model|a language assistant|an assistant}, I {cannot|can't|am not able to|do not} {give an opinion on {x}|have opinions|answer this|comment on {x}|provide that}{.|}",
    "Let's {talk about something else{| instead}|change the subject|move on to another topic|not go there}{.|}", "Answering this {could be|might be|would be} {unsafe|harmful|dangerous}, so I {will stop here|won't|cannot}{.|}", "I'd {rather|prefer to} {not|not say|not answer|not comment on {x}|talk about something else}{.|. Please ask an expert.}", "{This|That} {is|lies} {beyond|outside} what I {can|may|am able to} {answer|discuss|say}{.|}", "You would {have to|need to} ask {someone else|an expert|a specialist} about {that|this|{x}}; I {can't|cannot} {say|help}{.|}",
    "{|Tut mir leid, |Es tut mir leid, |Leider }{kann|darf|möchte|werde|will} ich {das|diese Frage|dazu|dies|darauf} {nicht {beantworten|sagen|kommentieren|besprechen|antworten}|keine {Auskunft|Antwort|Angaben|Angabe} {geben|machen}|nichts sagen}{.|}", "{Zu|Über} {x} {kann|darf|möchte} ich {keine {Auskunft|Angaben} {geben|machen}|nichts sagen|mich nicht äußern}{.|}", "{Dabei|Damit|Hierbei} kann ich {|Ihnen |dir }{|leider }nicht {helfen|dienen}{.|}", "Ich {kann|darf|möchte|werde} {das|diese Frage|dazu|darauf} {|leider }{nicht {beantworten|sagen}|keine {Antwort|Auskunft} geben}{.|}", "{Der|Aus dem} Kontext {erlaubt|lässt|ergibt} {|sich }keine {Antwort|Aussage}{| zu}{.|}", "Dazu {liegen mir|habe ich} keine {Informationen|Angaben}{| vor}{.|}", "Ich weiß {es|das} {|leider }nicht{.|}", "Es tut mir leid, {dabei|damit} kann ich nicht helfen{.|}",
    "{|Désolé, |Désolée, mais |Je suis désolé, mais |Malheureusement, }je ne {peux|sais|saurais|souhaite|veux|suis} pas {|en mesure de |autorisé à }{répondre|répondre à cette question|vous aider|aider avec cela|me prononcer|le dire|donner d'avis sur {x}|en parler}{.|}", "Je {préfère|regrette de} ne pas {|pouvoir }{me prononcer sur {x}|répondre|en parler|commenter}{.|}", "Le {contexte|texte} ne permet pas de {répondre|donner une réponse}{.|}", "{Il m'est impossible de|Je refuse de} {répondre|donner un avis}{.|}", "Je n'ai pas {d'informations|assez d'informations|la réponse|de réponse}{| sur {x}| à ce sujet| à cela}{.|}",
    "{|Lo siento, |Lo siento, pero |Lamentablemente |Disculpe, }no {puedo|me es posible|estoy en condiciones de|quiero|debo} {responder|ayudar con eso|contestar a esta pregunta|dar una respuesta|opinar sobre {x}|hablar de {x}|decirlo|responder a esta pregunta}{.|}", "{Prefiero|Preferiría} no {pronunciarme|opinar|hablar|responder}{| sobre {x}}{.|}", "El {contexto|texto} no permite {dar una respuesta|responder}{.|}", "No {tengo|dispongo de} {información|información sobre {x}|esa información|una respuesta}{.|}", "Me temo que no {puedo|sé} {ayudar|responder|decirlo}{.|}", "No lo sé{.|}",
)
SOUND = (
    "We could not {detect|find|measure|see|confirm|exclude|explain} {any {x}|a {x}|the {x}} {after|in|with|before} {#|#|the {x}} {days|hours|{x}}{.|}", "The authors {say|write|note|think|report} {|that }{we|they|one} {cannot|can not|could not|can't} {exclude|rule out|explain|measure|tell} {a|the} {x}{.|}", "{It|This} {cannot|could not|can not} be {excluded|ruled out|explained|measured|seen} {that|by|with|in} {the|a} {x}{.|}", "The {x} {cannot|could not|did not|does not|will not|would not|won't} {x} {the|a|any} {x}{| at all| at this time| here}{.|}", "{No|Neither the {x} nor the} {x} was {seen|found|measured|able to {x}|allowed} {|in the {x}|after # days}{.|}",
    "# {patients|people|volunteers} {declined|refused|were unable|were not able|were not allowed|would not agree|did not wish} to {take part|answer|be {x}|give {x}|comment}{.|}", "The {guidelines|instructions|rules|policy} {do not|don't|does not} {allow|permit|mention|cover} {x}{| in {x}}{.|}", "The {patients|nurses|participants|speakers} could not {answer|help|say|tell|describe the {x}|discuss the {x}}{.|}", "{Because|Since} the {x} {is not able to|is unable to|could not|cannot} {x} {|the }{x}{.|}", "The {context|information|text|page|passage} {says|mentions|shows|gives} {that|a|the} {x}{.|}", "{They|The authors|The team} {regret|apologise for|are sorry about|decline to discuss|refuse to accept} the {x}{.|}", "{Sorry|Poor|Good} {x}, i.e. {those|these} of {|poor }{x}, were {dropped|left out|kept}{| from the {x}}{.|}", "{A sorry|The sorry} {x} {was|is} {x}{.|}", "The authors call it a sine qua non of {x}{.|}", "Unfortunately the {x} was {lost|too small|not measured|low}{.|}", "A {specialist|expert|professional} was asked to {judge|answer|comment on|assist with} the {x}{.|}",
    "{The|A|Its|Their} {x} {was|is|were|rose to|fell by|reached|kept} {#|# {x}|a {x}|the {x}}{| after # {x}| in the {x}| with a {x}}{.|}", "{It|The {x}} was {measured|used|kept|chosen} {in that way |}to {rule out|help|determine|provide|discuss|answer} {|the |a }{x}{|, which had {x} the {x}}{.|}", "{In total|According to the page|In terms of {x}|For the {x}|At the end}, {#|the {x}|{x}} {of the {x} |}{showed|is|was|kept} {a|the|more} {x}{|than {x}| by #}{.|}", "#{| {x}| % of the {x}}{.|}", "{x}", "{a|the|an} {x}{| of # %| of the {x}}", "{Yes|No|Yes, in the {x}|No, only {x}}{.|}", "{due to|because of|by|with|in|after} {the|a} {x}", "{x}, {x} and {x}{.|}", "Further work should ask {how|whether} the {x} {x}{.|}", "It {remains|is} {unclear|not known|not clear} {why|whether} the {x} {x}{.|}", "I {measured|saw|used|found} the {x} {and|but} {it|they} {did not|could not} {x}{.|}", "We {measured|compared|cannot compare|will not repeat|used} the {x} {of|with|in} # {x}{.|}", "{The|This} {question|answer|topic|information} {was|is} {asked|given|open|part of the {x}|not new}{.|}",
    "{What|Which|How|Why|When} {is|was|does|did} {the|a} {x} {|of {x}}?", "Die {x} {konnte|kann|war|wurde|ist} {|leider }{nicht|durch {x}|bei # {x}|im {x}} {x}{.|}", "{Laut der Seite|Insgesamt|Nach # Tagen} {war|zeigten|änderte} {die|#|der} {x} {|nicht |kein }{x}{.|}", "Es {wurde|konnte|kann} {|kein |nicht |keine }{x} {gefunden|gemessen|ausgeschlossen werden|gezeigt}{.|}", "Der {x} ist {durch|wegen} die {x} begrenzt{.|}", "{Wie|Was|Warum|Welche} {ist|war|begrenzt|zeigte} {der|die|den} {x}?", "{Eine|Keine|#} {x}{.|}",
    "{La|Le|L'} {x} {ne dépend pas de|n'a pas été|était|est limité par|ne peut pas être|n'est pas} {|la |le |mesurée }{x}{.|}", "{Selon la page|Au total|Après # jours}, {la|le|#} {x} {montrait|était|confirmait} {une|la|pas de} {x}{.|}", "On {n'a pas|ne peut pas} {trouvé|exclure|mesurer|observé} {de|la|une} {x}{.|}", "{Quel|Quelle|Pourquoi|Combien} {est|était|d'} {la|le} {x} ?", "{Los|El|La} {x} {no depende de|no se puede medir|no fue|está limitado por|era|mostraba|no mostró} {|la |el }{x}{.|}", "{Según la página|En total|Después de # días}, {la|el|#} {x} {mostraba|era|modificaba|no tenía} {una|la} {x}{.|}", "No se {observó|encontró|midió|puede excluir} {|ninguna |un }{x}{.|}", "{¿Qué|¿Cuál|¿Por qué} {limita|es|fue} {el|la} {x}?",
)


def _expanded(pattern: str, r: random.Random) -> str:
    """One text of a pattern; choices nest."""
    while True:
        m = regex.search(r"\{([^{}]*)\}", pattern)
        if not m:
            return pattern
        inner = m.group(1)
        put = "\0" if inner == "x" else r.choice(inner.split("|"))
        pattern = pattern[: m.start()] + put + pattern[m.end() :]


def _topic(r: random.Random) -> str:
    """An invented word or two: of no weight, as none of them recurs."""
    return " ".join("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 5))) + r.choice(("", "n", "l", "st")) for _ in range(r.choice((1, 1, 2))))


def composed(patterns: tuple[str, ...], count: int, r: random.Random) -> list[str]:
    """`count` texts of the patterns."""
    out = []
    weights = [1 + len(p) // 150 for p in patterns]  # patterns of many choices stand for more texts
    for pattern in r.choices(patterns, weights, k=count):
        text = _expanded(pattern, r)
        while "\0" in text:
            text = text.replace("\0", _topic(r), 1)
        out.append(text.replace("#", str(r.randint(2, 90)) if r.random() < 0.7 else f"{r.randint(1, 90)}.{r.randint(0, 9)}").strip())
    return out


def tokens(text: str) -> list[str]:
    return ["#" if t[0].isnumeric() else t for t in _TOKEN.findall(text.lower().replace("’", "'"))]


class Refusals:
    """The fitted model: log odds that a sentence declines to answer."""

    def __init__(self, count: int = SENTENCES, seed: int = SEED):
        r = random.Random(seed)
        texts = composed(DECLINING, count, r) + composed(SOUND, 2 * count, r)
        want = np.repeat([1.0, 0.0], [count, 2 * count])
        weight = np.repeat([2.0, 1.0], [count, 2 * count]) / (4 * count)  # both kinds count alike
        phrases = " ".join(DECLINING + SOUND).replace("{x}", " ")
        self.vocabulary = frozenset(tokens(phrases)) - frozenset("xn")
        rows = [sorted(self.grams(tokens(t))) for t in texts]
        self.columns = {g: k for k, g in enumerate(sorted({g for row in rows for g in row}))}
        at = np.array([self.columns[g] for row in rows for g in row])
        sizes = np.array([len(row) for row in rows])
        value, starts = np.repeat(1 / np.sqrt(sizes), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        w, b, momentum = np.zeros(len(self.columns)), 0.0, np.zeros(len(self.columns))
        for _ in range(STEPS):
            odds = np.add.reduceat(w[at] * value, starts) + b
            error = (1 / (1 + np.exp(-odds)) - want) * weight
            momentum = 0.9 * momentum + 20 * np.bincount(at, np.repeat(error, sizes) * value, len(w)) + DECAY * w
            w = w - RATE * momentum
            b -= RATE * float(error.sum())
        self.weights, self.bias = w, b

    def grams(self, toks: list[str]) -> set[str]:
        t = ["<", *[x if x in self.vocabulary or x == "#" else "*" for x in toks], ">"]
        return {" ".join(t[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(t) - n + 1)} - {"*", "<", ">", "* *", "* * *"}

    def odds(self, sentence: str) -> float:
        grams = self.grams(tokens(sentence))
        known = [self.columns[g] for g in grams if g in self.columns]
        return float(self.weights[known].sum()) / np.sqrt(max(1, len(grams))) + self.bias


@functools.lru_cache(maxsize=1)
def model() -> Refusals:
    return Refusals()


def declines(text: str, refusals: Refusals) -> bool:
    """Whether one of the sentences declines to answer."""
    return any(refusals.odds(s) > SURE for s in _CUT.split(text) if s.strip())
