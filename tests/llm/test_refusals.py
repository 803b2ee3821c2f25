"""Refusals and non-refusals that the lists of the library were not made from."""

import pytest

from assaylake.llm.refusals import refuses

HELD_OUT = {
    "en": """I'm sorry, I can't do that.
I will not provide this information.
I am not comfortable answering that.
Sorry, but I'm unable to answer this question.
I cannot comply with this request.
I won't be able to help you with that.
I'm afraid I can't discuss this topic.
I am not able to share those details.
Unfortunately I cannot assist you here.
I must respectfully decline to answer.
I do not feel comfortable giving that advice.
I'm not permitted to disclose this information.
We are unable to respond to your question.
I have to refuse this request.
I can't give you an answer to that.
I am not in a position to advise on it.
I would rather not say.
I'm not going to write that.
It is against my guidelines to answer.
I shall not take part in this.""",
    "de": """Das kann ich leider nicht beantworten.
Ich kann diese Anfrage nicht beantworten.
Es ist mir nicht gestattet, darauf einzugehen.
Dabei kann ich Ihnen leider nicht helfen.
Ich darf dazu keine Auskunft geben.
Leider bin ich nicht in der Lage, Ihnen zu helfen.
Ich möchte diese Frage nicht beantworten.
Ich werde diese Informationen nicht teilen.
Dazu kann ich nichts sagen, und ich werde nicht antworten.
Ich muss diese Anfrage ablehnen.
Entschuldigung, ich kann Ihnen hier nicht weiterhelfen.
Wir können Ihrem Wunsch leider nicht nachkommen.
Ich bin nicht befugt, Auskunft zu geben.
Das darf ich dir nicht sagen.
Ich kann dir bei dieser Aufgabe nicht behilflich sein.
Mir ist nicht erlaubt, darüber zu reden.
Ich lehne diese Anfrage ab.
Ich werde das nicht tun.
Hierzu kann ich keine Informationen geben.
Ich kann Ihnen keine Antwort geben.""",
    "fr": """Je ne suis pas en mesure de répondre.
Désolé, je ne peux pas répondre à cette question.
Je ne peux pas vous fournir ces informations.
Il m'est impossible de répondre à cette demande.
Je refuse de répondre.
Je dois décliner cette demande.
Malheureusement, je ne peux pas faire cela.
Nous ne sommes pas autorisés à répondre, je ne peux pas vous aider.
Je ne souhaite pas répondre à cela.
Je ne suis pas autorisé à partager ces détails.
Je ne saurais vous aider sur ce point.
Je ne pourrai pas vous aider.
Je ne peux malheureusement pas vous renseigner.
Je ne veux pas participer à cela.
Il ne m'est pas permis de répondre.
Je ne suis pas habilité à vous donner cette information.
Je suis contraint de refuser cette demande.
Je ne vais pas répondre à cette question.
Je suis incapable de vous aider.
Je ne puis donner de réponse.""",
    "es": """Lo siento, no puedo responder a eso.
No puedo ayudarte con esta solicitud.
No estoy autorizado a responder.
Lamentablemente no puedo proporcionar esa información.
Debo rechazar esta petición.
No me es posible responder a esta pregunta.
No voy a responder a eso.
No quiero participar en esto.
Me niego a responder.
No estoy en condiciones de ayudarle.
No podemos atender su solicitud.
No puedo hacer eso.
Tengo que declinar esta solicitud.
No puedo compartir esos detalles.
Perdón, pero no podré ayudarle con esto.
No me está permitido dar esa información.
No tengo autorización y no puedo contestar.
Prefiero abstenerme; no puedo contestar.
No soy capaz de responder a esta pregunta.
No puedo darte una respuesta.""",
    "pt": """Desculpe, não posso responder a isso.
Não posso ajudar com esse pedido.
Não estou autorizado a responder.
Infelizmente não posso fornecer essa informação.
Devo recusar este pedido.
Não me é possível responder a esta pergunta.
Não vou responder a isso.
Não quero participar nisto.
Recuso responder a esta pergunta.
Não consigo ajudar com isso.
Não podemos atender ao seu pedido.
Não posso fazer isso.
Tenho de declinar este pedido.
Não posso compartilhar esses detalhes.
Lamento, mas não poderei ajudar.
Não me é permitido dar essa informação.
Não estou em condições de ajudar.
Não posso dar uma resposta.
Não devo responder a essa pergunta.
Infelizmente não consigo responder.""",
    "it": """Mi dispiace, non posso rispondere a questa domanda.
Non posso aiutarti con questa richiesta.
Non sono autorizzato a rispondere.
Purtroppo non posso fornire queste informazioni.
Devo rifiutare questa richiesta.
Non mi è possibile rispondere.
Non intendo rispondere a questo.
Non voglio partecipare.
Rifiuto di rispondere.
Non sono in grado di aiutarla.
Non possiamo soddisfare la sua richiesta.
Non posso fare questo.
Devo declinare questa richiesta.
Non posso condividere tali dettagli.
Scusa, ma non potrò aiutarti.
Non mi è consentito dare queste informazioni.
Non riesco a rispondere a questa domanda.
Non posso darti una risposta.
Non mi è permesso rispondere.
Mi è vietato rispondere.""",
    "nl": """Sorry, ik kan daar niet op antwoorden.
Ik kan je hier niet bij helpen.
Ik ben niet bevoegd om te antwoorden.
Helaas kan ik deze informatie niet verstrekken.
Ik moet dit verzoek weigeren.
Het is mij niet toegestaan te antwoorden.
Ik ga niet antwoorden, dat wil ik niet doen.
Ik wil hier niet aan meewerken.
Ik weiger dit verzoek.
Ik ben niet in staat u te helpen.
Wij kunnen niet aan uw verzoek voldoen.
Dat kan ik niet doen.
Ik moet deze vraag afwijzen.
Ik mag die details niet delen.
Het spijt me, maar ik kan u niet helpen.
Ik kan je geen antwoord geven.
Deze vraag kan ik niet beantwoorden.
Daar mag ik geen informatie over geven.
Ik zal dat niet zeggen.
Ik kan u geen advies geven.""",
    "ru": """Извините, я не могу ответить на этот вопрос.
Я не могу вам помочь с этим.
Мне не разрешено отвечать.
К сожалению, не могу предоставить эту информацию.
Я вынужден отказаться отвечать.
Я не буду отвечать на это.
Я не готов обсуждать это.
Я отказываюсь отвечать на этот вопрос.
Мы не можем выполнить ваш запрос, не могу это сделать.
Я не вправе сообщать эти сведения, не могу ответить.
Я не хочу участвовать в этом.
Не могу дать ответ на этот вопрос.
Я должен отклонить этот запрос.
Мне запрещено отвечать на это.
Я не в состоянии помочь.
Я не смогу ответить.
Не могу рассказать об этом.
Я не могу это сделать.
Я не могу поделиться этой информацией.
Мне нельзя отвечать на такой вопрос.""",
    "ja": """申し訳ありませんが、お答えできません。
その質問には回答いたしかねます。
この件についてはお手伝いできません。
ご要望には対応いたしかねます。
その情報は提供できません。
この依頼はお断りいたします。
回答は控えさせていただきます。
お力になれません。
ご案内することはできません。
その内容についてはお話しできません。
私はこれに答えることはできません。
ご協力いたしかねます。
その依頼には応じられません。
回答を辞退します。
申し訳ございません、お応えできません。
詳細を開示することはできません。
助言はいたしかねます。
返答できません。
お伝えできません。
参加できません。""",
}
WHOLE = """I can see that the desk did not help the tenant.
I am not sure whether the clerk can answer the call.
The desk cannot help the tenant until consent is known.
I can't see any blocker on the lot, so the next action is to seal it.
I do not see a reason to wait; the lot can be sealed.
The owner refused the order, and the clerk declined the lot.
The guidelines do allow the transfer, so I would release it.
I have to decline the lot, because its seal is broken.
They could not answer in time, so I moved the slot.
Ich sehe, dass der Kunde nicht zahlen kann.
Der Kundendienst kann diese Frage nicht beantworten.
Ich kann den Posten nicht finden, daher sperre ich ihn.
Je ne vois pas de blocage, donc le lot peut partir.
Le service ne peut pas répondre avant lundi.
No veo ningún bloqueo en el lote.
El servicio no puede responder hasta el lunes.
Não vejo nenhum bloqueio no lote.
O serviço não pode responder até segunda-feira.
Non vedo alcun blocco sul lotto.
Il servizio non può rispondere fino a lunedì.
Ik zie geen blokkade op de partij.
De dienst kan deze vraag niet beantwoorden.
Я не вижу препятствий для партии.
Служба не может ответить до понедельника.
倉庫の担当者は荷物を封印しました。
次の担当者は期限を確認します。""".splitlines()


@pytest.mark.parametrize("lang", HELD_OUT)
def test_recall_of_held_out_refusals(lang):
    sentences = HELD_OUT[lang].splitlines()
    missed = [s for s in sentences if not refuses(s)]
    assert len(sentences) >= 20 and len(missed) <= len(sentences) // 10, missed


def test_what_others_cannot_do_is_no_refusal():
    assert [s for s in WHOLE if refuses(s)] == []


@pytest.mark.parametrize("lang", HELD_OUT)
def test_quoted_refusals_are_none(lang):
    a, b = ("「", "」") if lang == "ja" else ('"', '"')
    assert [s for s in HELD_OUT[lang].splitlines() if refuses(f"The note says {a}{s}{b} and was filed.")] == []


def test_a_long_answer_can_refuse_in_its_opening_or_closing_sentence():
    long = "The lot was sealed by the depot foreman. " * 300
    assert refuses("I'm sorry, I can't help with this request. " + long)
    assert refuses(long + "For this reason I won't answer the question.")
    assert not refuses(long + "I can't help with this request. " + long)
    assert not refuses("") and not refuses("。")
