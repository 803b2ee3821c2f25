"""Word and phrase lists in plain text, one table per purpose."""

# Closed-class words (articles, pronouns, prepositions, conjunctions, auxiliaries) of the languages written with spaces.
STOPWORDS = {
    "en": "a an the this that these those of to in on at by for from with without into onto about between through during against among under over before after since until while and or but nor because although though if unless whereas whether is are was were be been being has have had do does did will would shall should can could may might must not it its he him his she her they them their we us our you your i me my who whom whose which what when where why how as than then there here all each every both either neither some any no such".split(),
    "de": "der die das den dem des ein eine einen einem einer eines dieser diese dieses diesem diesen jener jene und oder aber sondern denn weil dass ob obwohl wenn als wie während bevor nachdem damit ist sind war waren sein wird werden wurde wurden worden hat haben hatte hatten kann können muss müssen soll darf nicht kein keine keinen mit von zu zum zur bei beim nach vor aus auf für im in an am um durch gegen ohne seit trotz wegen zwischen über unter ich du er sie es wir ihr sich mich mir ihm ihn ihnen auch nur noch schon".split(),
    "fr": "le la les un une des du de ce cet cette ces et ou mais donc or ni car que qui quoi dont où si comme quand lorsque puisque parce afin est sont était étaient être été a ont avait avaient avoir eu sera ne pas plus dans par pour sur sous avec sans avant après depuis pendant entre vers chez contre malgré je tu il elle nous vous ils elles on se son sa ses leur leurs mon ma mes au aux en y lui".split(),
    "es": "el la los las un una unos unas este esta estos estas ese esa esos esas y o u pero sino ni que quien cuyo si como cuando donde aunque porque mientras pues es son era eran ser sido está están estaba ha han había haber fue fueron no de del a al en con por para sin sobre bajo entre desde hasta hacia durante contra según tras yo tú él ella nosotros ellos ellas se su sus mi lo le les me te nos muy ya también antes después".split(),
    "pt": "o a os as um uma uns umas este esta estes estas esse essa isso isto aquele aquela e ou mas nem que quem cujo se como quando onde embora porque enquanto pois é são era eram ser sido está estão estava tem têm tinha foi foram não de do da dos das em no na nos nas ao aos à às com por pelo pela pelos pelas para sem sob sobre entre desde até durante contra após eu tu ele ela nós eles elas seu sua seus suas lhe me já também antes depois".split(),
    "it": "il lo la i gli le un uno una questo questa questi queste quello quella e o ma né che chi cui se come quando dove benché perché mentre poiché è sono era erano essere stato stata ha hanno aveva avere fu non di del dello della dei degli delle a al allo alla ai agli alle da dal dalla dai in nel nella nei con su sul sulla per senza sotto sopra tra fra durante contro dopo prima io tu lui lei noi voi loro si suo sua suoi ne ci già anche più".split(),
    "nl": "de het een deze dit die dat en of maar want noch omdat hoewel als toen terwijl voordat nadat zodat is zijn was waren wordt worden werd werden geweest heeft hebben had hadden kan kunnen moet moeten mag zal niet geen van in op aan met voor door bij naar uit tot om over onder tussen tegen zonder sinds tijdens tegenover te ik jij hij zij wij ze er we u hem haar hun zich mijn ons ook nog al".split(),
    "ru": "и а но или что чтобы если когда пока как так это этот эта эти тот та те который которая которые где куда откуда почему потому поэтому хотя ли не ни нет да в во на с со из от до по за под над при для без к ко о об у через между перед после был была было были есть будет быть я ты он она оно мы вы они его её ее их ему ей им меня тебя нас вас себя свой своя свои мой наш ваш уже ещё еще только также же бы".split(),
}

# The parts of which answers of the speaker's own refusal are made, by language: who speaks (I; also in M where
# the verb says it), ability or will (M), negation (G), the act declined (A; with a star only where an object of O follows),
# declining outright (D), what is declined (O), verbs that speak in the first person themselves (F), and what begins another
# clause (B). Lower case, contractions undone.
REFUSALS = {
    "en": {
        "I": "i we me us my", "M": "can could will would shall may must am are do feel be able", "G": "not unable unwilling never",
        "A": "help helping assist assisting answer answering comply complying fulfil fulfill respond responding discuss discussing engage advise participate participating part reply accommodate cooperate take* do* doing* provide* providing* give* giving* share* sharing* offer* write* generate* produce* create* tell* say* support* supporting* address* disclose* reveal*",
        "D": "decline refuse abstain refrain declining refusing pass", "O": "this that it so something these those request question answer information details advice guidance response content opinion help anything assistance such your to from here on part answering helping task instead with",
        "B": "the whether if that until because who",
    },
    "de": {
        "I": "ich wir mir uns", "M": "kann können könnte darf dürfen möchte werde will bin ist sehe wird ausserstande außerstande vermag", "G": "nicht keine kein keinen keinerlei unmöglich außerstande ausserstande untersagt verboten",
        "A": "helfen weiterhelfen beantworten antworten beantwortung unterstützen unterstützung behilflich auskunft auskünfte mitmachen nachkommen dienen äußern entsprechen eingehen gestattet erlaubt hilfe antwort geben* liefern* teilen* mitteilen* bereitstellen* sagen* tun* machen* möglich* erfüllen* schreiben* helfe beantworte",
        "D": "ablehnen verweigern verzichten ablehne lehne weigere", "O": "das dies diese diesen diese bitte frage anfrage informationen information antwort auskunft dazu hierzu dabei damit darauf hilfe ihnen anliegen wunsch ab aufgabe",
        "B": "ob wenn bis dass weil",
    },
    "fr": {
        "I": "je nous me m j", "M": "peux pouvons pourrai pourrais puis suis veux souhaite saurais vais est sommes voulons", "G": "pas impossible incapable jamais interdit défendu",
        "A": "aider répondre assister assistance réponse participer satisfaire accéder renseigner aide autorisé autorisée permis habilité aborder discuter interdit défendu fournir* donner* partager* traiter* communiquer* faire* dire* divulguer* écrire* rédiger* impossible*",
        "D": "refuser décliner refuse décline abstenir contraint contrainte", "O": "cela ça ce cette demande question information informations réponse répondre détails conseil conseils aide votre de y refuser décliner",
        "B": "si que quand",
    },
    "es": {
        "I": "yo nosotros me nos", "M": "puedo podemos podré podría debo quiero estoy voy soy está es tengo estamos resulta", "G": "no imposible tampoco prohibido incapaz",
        "A": "ayudar ayudarte ayudarle ayudarlo ayudarla ayudarles responder responderte responderle contestar asistir asistirle asistirte colaborar participar permitido autorizado autorizada respuesta ayuda atender prohibido proporcionar* dar* darte* darle* facilitar* compartir* cumplir* hacer* decir* ofrecer* revelar* imposible*",
        "D": "rechazar negarme declinar rehusar abstenerme rechazo declino niego", "O": "eso esto esa esta este lo ello solicitud petición pregunta información respuesta detalles consejo ayuda datos su tu a con de responder contestar",
        "F": "puedo podemos podré podría debo quiero estoy voy soy tengo estamos", "B": "si que hasta cuando",
    },
    "pt": {
        "I": "eu nós me nos", "M": "posso podemos poderei poderia estou quero vou consigo devo é está sou tenho estamos conseguimos", "G": "não impossível incapaz proibido tampouco",
        "A": "ajudar ajudá responder auxiliar colaborar participar permitido autorizado autorizada resposta ajuda atender assistir apoiar proibido fornecer* dar* partilhar* compartilhar* cumprir* fazer* dizer* oferecer* revelar* prestar* divulgar* impossível*",
        "D": "recusar declinar rejeitar abster recuso declino negar", "O": "isso isto essa este esta esse pedido pergunta informação informações resposta detalhes ajuda conselho seu sua a lo la com responder solicitação me",
        "F": "posso podemos poderei poderia estou quero vou consigo devo sou tenho estamos conseguimos", "B": "se que até quando",
    },
    "it": {
        "I": "io noi mi ci", "M": "posso possiamo potrò potrei sono voglio devo intendo riesco è siamo", "G": "non impossibile neppure vietato incapace",
        "A": "aiutare aiutarti aiutarla aiutarvi aiutarlo rispondere risponderti risponderle assistere assisterti assisterla collaborare partecipare permesso consentito autorizzato autorizzata risposta aiuto vietato fornire* fornirti* fornirle* dare* darti* darle* condividere* soddisfare* fare* farlo dire* offrire* rivelare* impossibile*",
        "D": "rifiutare declinare rifiutarmi astenermi rifiuto declino", "O": "questo questa ciò lo richiesta domanda informazioni informazione risposta dettagli consigli consiglio aiuto quello tale di a rispondere con mi",
        "F": "posso possiamo potrò potrei sono voglio devo intendo riesco siamo", "B": "se che finché quando",
    },
    "nl": {
        "I": "ik wij we mij me ons", "M": "kan kunnen mag mogen wil ben zal is zou kon", "G": "niet geen onmogelijk verboden nooit",
        "A": "helpen beantwoorden antwoorden assisteren bijstaan meewerken behulpzaam toegestaan antwoord meedoen hulp voldoen verboden reageren verstrekken* geven* delen* doen* zeggen* leveren* bieden* maken* schrijven* ingaan* onmogelijk*",
        "D": "afwijzen weigeren afslaan weiger onthouden", "O": "dit dat deze die daarmee hiermee daarop hierop verzoek vraag informatie antwoord details advies hulp je u daaraan hieraan daarbij hierbij",
        "B": "of dat tot als",
    },
    "ru": {
        "I": "я мы мне нам", "M": "разрешено позволено нельзя невозможно могу можем смогу буду готов готова вправе имею хочу будем в сможем", "G": "не нельзя невозможно",
        "A": "помочь помогать ответить отвечать содействовать участвовать разрешено позволено ответа обсуждать состоянии помощь предоставить* сообщить* дать* выполнить* поделиться* давать* делать* сделать* рассказать* предоставлять* раскрывать* это*",
        "D": "отклонить отказать отказаться отказываюсь запрещено отклоняю воздержусь воздержаться", "O": "это этот эту этим этого этом этой эти этих вопрос запрос просьбу просьбе информацию ответ подробности сведения вам помощь в от отвечать на помогать такой такую",
        "F": "могу можем смогу буду готов готова хочу будем сможем вынужден вынуждена должен должна отказываюсь отклоняю воздержусь вправе имею", "B": "что если пока",
    },
}
# Whole turns of English that refuse without naming an act.
REFUSING_TURNS = ("i would rather not", "outside what i am", "outside of what i am", "beyond what i am", "against my guidelines", "against my instructions", "against my policy", "guidelines do not allow", "guidelines do not permit", "instructions do not allow", "instructions do not permit")
# The same of Japanese, which has no spaces: acts, and what denies them within a few signs; and outright declining.
REFUSALS_JA = {
    "A": "お手伝い お答え 回答 お応え 対応 返答 返信 協力 ご協力 支援 ご案内 提供 お力 お教え お伝え 助言 お助け 応じる 応じ 答える 手伝う 手伝え 答え 参加 開示 お話し".split(),
    "G": "できません できかねます いたしかねます 致しかねます しかねます できない なれません られません ことはできません わけにはいきません かねます えません いたしません 許されていません".split(),
    "D": "お断り 断らせて 辞退 許可されていません 認められていません 控えさせて ご遠慮 遠慮させて 禁じられて 拒否いたします 拒否します".split(),
}
# Answers that stand for nothing.
PLACEHOLDERS = {"n/a", "na", "null", "none", "nil", "-", "--", "—", "...", "…", "\"\"", "''", "<empty>", "<none>", "<null>", "(empty)", "[empty]", "empty", "tbd", "?", "undefined", "```json\n```", "```\n```"}
