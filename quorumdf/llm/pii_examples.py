"""The small labelled table the personal-data tagger is trained from.

The rows were written for this module from everyday correspondence in seven languages; none was taken from a table
that is tagged.  ``{name}``, ``{email}``, ``{phone}``, ``{id}`` and ``{address}`` mark labelled spans; ``{w}`` is an
unlabelled invented word (product, town), ``{firm}`` a firm, ``{role}`` a person without a name, ``{#}`` an
unlabelled number, ``{code}`` a code, ``{n.en}``, ``{a.en}``, ``{v.en}`` and the like ordinary words of a language, and ``[x|y]`` a
choice of wordings.  :func:`sequences` fills the marks with invented values, so the tagger learns contexts and
shapes, not the values themselves.
"""

from __future__ import annotations

import random
import re

LABELLED = """
My [first|full|last|real|maiden] name is {name}.
[His|Her|The tenant's|My son's] name is {name}.
The name's {name}.
You may call me {name}.
I'm {name}.
I'm {name}, we met in {w}.
[Mr|Mrs|Ms|Mr.|Ms.] {name} of your {n.en} team [came|phoned|wrote] [again|once].
[Mr|Mrs|Dr.|Prof.] {name} [came|left|paid|agreed].
[Dr.|Dr|Mr|Mrs] {name} has {v.en} it.
[Doctor|Nurse|Captain|Judge|Professor] {name} wants the {n.en}.
The box was taken in by {name}.
We deposited the {n.en} with {name}.
Better ask {name}, I am [ill|busy|away].
Look for {name} there.
Someone gave the {n.en} to {name}.
Nobody but {name} has the key.
I only trust {name}.
Only {name} can {v.en} it.
{name} [knows|saw|heard] everything.
{name} [lives|works] next door, please ring there.
Tell {name} that the {n.en} is {a.en}.
Thanks to {name} for the help.
I wrote to {name}, no answer.
Is {name} still with you?
My [lawyer|doctor|assistant|partner|tenant] is {name}.
My [lawyer|doctor|assistant|partner|tenant], {name}, {v.en} the {n.en}.
[Best|Regards|Thanks|Cheers|Yours], {name}
[Best|Thanks again|Bye|Love],\\n{name}
-- {name}
~ {name}
— {name}, {w}
Signed: {name}
In the name of {name}: please {v.en} the {n.en}.
Invite {name} as well.
With {name} I {v.en} the {n.en}.
I am {name} and I [own|rent|run] the {n.en} [next door|downstairs].
This is {name} [speaking|writing|again].
[Yesterday|Last week] {name} [told|promised|showed] me the {n.en} was {a.en}.
{name} will [collect|sign for|bring back] the {n.en} [tomorrow|on Friday].
I [talked|wrote|complained] to {name} about the {n.en}.
Could you [connect|put] me through to {name}?
The {n.en} was [signed|approved|opened] by {name}.
[Hand|Give|Forward] it to {name} [directly|only].
My [husband|wife|brother|daughter|colleague] {name} has the {n.en}.
{role}, {name}, was very {a.en}.
Our {role}, {name}, will {v.en} it.
We met {name} at the {n.en}.
The account belongs to {name}, not to me.
On behalf of {name} I {v.en} the {n.en}.
[Sir|Madam|Miss|Mister|Prof.|Doctor] {name} [agrees|refused|was there].
[Dr.|Mr.|Mrs.|Ms.|Prof.] {name} {v.en} [the {n.en}|everything].
{name} here with a [question|complaint|reminder].
{name} [here|again], [quick question|second message].
The {n.en} [stays|remained|was found] with {name}.
It was [picked up|handed in|brought] by {name}.
[Spoke|Talked|Gave it] to {name} [at length|yesterday].
The key is with {name}.
{cap.name}[:|=| -] {name}
- {cap.name}: {name}
{cap.name}: {name}; {cap.w}: {w}
{cap.w}: {w} | {cap.name}: {name}
"{cap.name}": "{name}", "{cap.w}": "{w}"
[Mr.|Mrs.|Ms.|Dr] {name} [asked|called|came] [twice|yesterday], nobody {v.en} it.
It was {name} who {v.en} the {n.en}.
[Recipient|Full name|Contact person|Signed|Caller|Attn|Cardholder]: {name}
[Recipient|Full name|Account holder|Contact]={name}
[Yours|Yours sincerely|Sincerely|All the best|Cheers|Warm wishes|Many thanks|Best wishes],\\n{name}
[Yours truly|Sincerely|Greetings] {name}
Greetings from {name}
-{name}
Sent by {name}
[Ask|Call|Look] for {name} at the {n.en}.
They keep calling me {name}, which is my [son|aunt].
{name} and {name} [share|use] one {n.en}.
Hi {name}, the {n.en} is {a.en}.
Dear {name}, thank you for the {n.en}.
Hello, {name} again, [still waiting|any news]?
{name}: the {n.en} is {a.en}.
We are waiting for {name} to {v.en} it.
[Dr.|Prof.] {name} hat die {n.de} {v.de}.
Man nennt mich {name}.
Mein [Vorname|Nachname|ganzer Name] ist {name}.
Mein [Anwalt|Arzt|Partner] heißt {name}.
[Rufen|Suchen|Verlangen] Sie bitte {name}.
Bitte nach {name} [rufen|suchen|schicken].
Wo finde ich {name}?
Es war {name}, [nicht ich|ganz sicher].
Das Paket liegt bei {name}.
Fragen Sie {name}, bitte.
Danke an {name}.
[Gruß|Grüße|Danke|Tschüss],\\n{name}
Frau {name} aus der {n.de} [rief an|war da].
Ich bin {name} und [wohne|arbeite] hier.
Hier [spricht|schreibt] {name}.
[Gestern|Heute] hat {name} die {n.de} {v.de}.
Geben Sie es [bitte|nur] {name}.
[Herrn|Herr|Frau] {name} [habe ich|hat niemand] {v.de}.
[Frau|Herr] {name} [kennt|hat] die {n.de}.
Ansprechpartner: {name}
[Frau|Herr] {name} [hilft|weiß es|weiß mehr|weiß alles|ist informiert|war da].
[Mit besten Grüßen|Beste Grüße|Liebe Grüße|Gruß|Hochachtungsvoll]\\n{name}
Unterschrieben von {name}.
Meine Kollegin {name} hat die {n.de} {v.de}.
Ich habe mit {name} über die {n.de} gesprochen.
Verbinden Sie mich mit {name}.
Me llaman {name}, vivo en {w}.
Mi [apellido|nombre completo] es {name}.
[Señor|Señora|Sr.|Sra.] {name}, [gracias|perdone].
Me dicen {name}.
Busquen a {name}.
Pidan hablar con {name}.
Voten por {name}.
La caja está con {name}.
[Gracias|Saludos|Chao],\\n{name}
Avisen a {name}.
[Dr.|Dra.] {name} {v.es} la {n.es}.
Soy {name} y [espero|tengo] la {n.es}.
[Ayer|Hoy] {name} me {v.es} la {n.es}.
Hablé con {name} de la {n.es}.
[El señor|La señora|Don|Doña|Sra.|Sr.] {name} no {v.es} nada.
Mi [hermano|colega|vecina] {name} {v.es} la {n.es}.
[Atentamente|Saludos|Un abrazo|Saludos cordiales],\\n{name}
Firmado por {name}.
Persona de contacto: {name}
Llamen a {name} [mañana|hoy].
Mi nombre es {name}.
On m'appelle {name} ici.
Mon [nom complet|prénom] est {name}.
Le paquet est chez {name}.
[Merci|Bonne journée|À bientôt],\\n{name}
Prévenez {name}.
Cherchez {name}.
Voyez {name}, s'il vous plaît.
Attendez {name}.
Parlez à {name}.
[Dr|Me] {name} a {v.fr} la {n.fr}.
Je suis {name} et j'attends la {n.fr}.
Ici {name}, [bonjour|encore moi].
[Hier|Lundi] {name} a {v.fr} la {n.fr}.
J'ai parlé avec {name} de la {n.fr}.
[Madame|Monsieur|Mme|M.] {name} [n'a rien|a] {v.fr}.
Ma [collègue|voisine] {name} a {v.fr} la {n.fr}.
[Bien à vous|Salutations|Amicalement|Sincèrement],\\n{name}
Signé par {name}.
Mon nom est {name}.
Eu sou {name} e {v.pt} a {n.pt}.
Falei com {name} sobre a {n.pt}.
[Atenciosamente|Abraços|Obrigado],\\n{name}
[O senhor|A senhora|Dona] {name} {v.pt} a {n.pt}.
Chamo-me {name}.
Ik ben {name} en wacht op de {n.nl}.
Ik sprak met {name} over de {n.nl}.
[Meneer|Mevrouw|Dhr.|Mevr.] {name} heeft de {n.nl} {v.nl}.
[Groeten|Met vriendelijke groet|Hartelijke groet],\\n{name}
Это {name}.
Меня звать {name}.
Посылку взял {name}.
Позовите {name}.
Ищите {name}.
Скажите {name}, что {n.ru} {a.ru}.
Здесь {name}, {n.ru} не {v.ru}.
[Доктор|Г-н|Г-жа] {name} {v.ru} {n.ru}.
Я {name}, жду {n.ru}.
Говорил с {name} про {n.ru}.
[Госпожа|Господин|Коллега] {name} не {v.ru}.
Моё имя {name}.
Передайте {name}, что {n.ru} не {v.ru}.
[Спасибо|До свидания],\\n{name}
[Mail|Email|E-mail] me at {email} [tomorrow|any time].
[Reply|Answer|Respond] to {email}, thanks.
My [address|account|inbox|user name] is {email}.
[Redirect|Post] the {n.en} to {email}[.| as well.]
The {n.en} ended up at {email}.
[Contact|Reply-To|From|To|Bcc|Login|User|Account]: {email}
[user|login|contact|from]={email}
I registered with {email} last year.
{email} [bounces|is my old address|works better].
[Schreiben|Antworten] Sie an {email}.
Meine Adresse ist {email}, die {n.de} kam nie an.
Bitte die {n.de} an {email} schicken.
Escriban a {email} por la {n.es}.
Mi cuenta es {email}.
[Écrivez|Répondez] à {email}.
Mon compte est {email}.
Escrevam para {email}.
Stuur de {n.nl} naar {email}.
Пишите на {email}.
Моя почта {email}.
{name} ({email})
{name}, {email}
{name} / {phone} / {email}
[Dial|Phone|Try] {phone} [after lunch|before nine].
You can [reach|call|phone] us on {phone}.
My [mobile|landline|work number|cell] is {phone}.
I am on {phone} all day.
[Cell|Telephone|Mob.|Contact number|Ph|Landline|WhatsApp|Callback]: {phone}
[cell|mobile|telephone|contact]={phone}
{phone} is [my number|where to reach me].
Nobody picks up at {phone}.
The {n.en} hotline gave me {phone} to call.
Send a text to {phone}.
[Telefon|Handy|Mobil|Festnetz|Rückruf]: {phone}
Erreichbar bin ich unter {phone}.
[Bitte|Gern] zurückrufen: {phone}.
[Teléfono|Móvil|Tfno.]: {phone}
Mi número es {phone}.
Pueden llamar al {phone} por la {n.es}.
[Téléphone|Portable|Mobile] : {phone}
Mon numéro est le {phone}.
Vous pouvez appeler le {phone}.
[Telefone|Telemóvel|Celular]: {phone}
Liguem para {phone}.
[Telefoon|Mobiel]: {phone}
Bel {phone} over de {n.nl}.
[Телефон|Тел.|Моб.]: {phone}
Позвоните на {phone}.
Мой телефон {phone}.
My [{idcap}] is {id}.
My [{idcap}] [ends up as|should read] {id}, not as printed.
Why do you [need|keep|show] {id}, my [{idcap}]?
[{idcap}]: {id}
[{idcap}]: {id}; {cap.w}: {w}
{cap.w}: {w} | [{idcap}]: {id} | {cap.w}: {order}
The {n.en} [has|shows|holds] {id} as my [{idcap}].
[{idcap}] no. {id}
[{idcap}]={id}
[{idcap}] {id}
The form [rejects|lost|wants] my [{idcap}] {id}.
Your file lists {id} as my [{idcap}].
{id} (my [{idcap}]) is [wrong|public|on the label].
I entered {id} as [{idcap}], and it was refused.
Please delete {id} ([{idcap}]) from the {n.en}.
Meine [{idcap}] {id} steht offen in der {n.de}.
Mein [{idcap}] lautet {id}.
Meine [{idcap}] ist {id}, nicht {#}.
Die [{idcap}] {id} wurde nicht {v.de}.
Löschen Sie {id} ([{idcap}]) bitte.
Mi [{idcap}] es {id} y no otro.
Mi [{idcap}] {id} aparece en la {n.es}.
Borren {id}, es mi [{idcap}].
Mon [{idcap}] est {id}, [merci|attention].
Mon [{idcap}] {id} figure dans la {n.fr}.
Supprimez {id}, c'est mon [{idcap}].
Meu [{idcap}] é {id}.
Mijn [{idcap}] is {id}.
Мой [{idcap}] {id} не {v.ru}.
[My home is|I am staying|Now I stay] at {address}.
[Mail|Bring|Carry] the {n.en} to {address}.
[Home|Street|Delivery|Postal|Billing] address: {address}
[Ship to|Lives at|Residence|Home]: {address}
[addr|home|shipping]={address}
We [left|sold|bought] {address} last year.
The driver could not find {address}.
{address} is where the {n.en} should go.
New address:\\n{address}
[Adresse|Lieferadresse|Wohnort]: {address}
Wir wohnen jetzt in {address}.
Schicken Sie die {n.de} nach {address}.
Die alte Adresse war {address}.
[Dirección|Domicilio|Entrega]: {address}
Ahora vivo en {address}, segundo piso.
Manden la {n.es} a {address}.
[Adresse|Livraison|Domicile] : {address}
J'habite maintenant {address}.
Envoyez la {n.fr} au {address}.
[Morada|Endereço]: {address}
Moro em {address}.
[Adres|Bezorgadres]: {address}
Wij wonen op {address}.
[Адрес|Доставка]: {address}
Я живу: {address}
{name}, {address}
{name}\\n{address}
"Contact": "{name}", "Item": "{w}"
"Login": "{email}", "Item": "{w}"
"Mobile": "{phone}", "Ref": "{order}"
"Street": "{address}", "Shop": "{w}"
"[{idcap}]": "{id}", "Ref": "{order}"
{"Contact": "{name}", "Shop": "{w}"}
Contact: {name} | Item: {w} | Level: {plan}
Item: {w}; Contact: {name}; Level: {plan}
Shop: {w} | Contact: {name} | Ref: {order}
Street: {address}; Contact: {name}; Shop: {w}
Contact: {name}; Street: {address}; Mobile: {phone}
Contact={name}; Item={w}; Ref={order}
- Contact: {name}
* Contact - {name}
"""

UNLABELLED = """
The {a.en} {n.en} from {w} [broke|arrived] [today|last night].
{w} [is|was|feels] {a.en} and our {role} {v.en} the {n.en}.
{w} and {w} [disagree|do not talk to each other].
I bought the {n.en} in {w} for {money}.
We drove from {w} to {w} for a {a.en} {n.en}.
Our {role} [likes|hates|uses] the {w} {n.en}.
{role} said the {n.en} is {a.en}.
{role} and {role} {v.en} the {n.en}.
In {w} everything is {a.en}.
The {w} [portal|tool|service|tracker] shows {d2} {n.en} entries.
{firm} [sent|lost|billed] the {n.en} [again|twice].
Is {firm} [your partner|in charge of the {n.en}]?
I ordered from {firm}, ref {order}, for {money}.
{firm} and {firm} both {v.en} it.
[Invoice|Receipt|Case|Ticket|Order|Parcel|Reference] {order} [is|was] {a.en}.
[Invoice|Bill|Ref.|Case no.|Order no.]: {order}
[invoice|case|item]={order}
Serial number {code} [is scratched off|does not match].
S/N {code}
Lot {code}, shelf {d2}.
Part {code} does not fit.
Parcel code {code} is stuck in {w}.
Build {d2}.{d1}.{d2} of {w} [crashes|hangs].
{w} {d1}.{d2} is {a.en}.
Server 192.168.{d2}.{d1} is down since 1{d1}:{d2}.
Error {err} on page {d2}.
{err} appeared {d2} times.
On 20{d2}-1{d1}-{d2} at 0{d1}:{d2} the {n.en} was {a.en}.
They want {money}, not {money}.
We paid {money} for {d2} {n.en} licences on {plan}.
Please [upgrade|cancel|move] us to {plan}.
Item: {w}
Shop: {w}
Level: {plan}
Ref: {order}
item={w}
Our account is @{low} [on every network|there].
Follow @{low} or mention @{low}.
The {month} {n.en} was {a.en}.
{month} was {a.en}.
Grace period, rose garden, mark as read: the {n.en} menu is {a.en}.
Will you mark the page, or may I hope for a {n.en}?
Faith in the {n.en} is gone, joy too.
Why is the {a.en} {n.en} [gone|hidden|slow]?
Can you {v.en} the {a.en} {n.en}, please?
Nobody {v.en} the {n.en} this year.
After {d2} days the {a.en} {n.en} is still {a.en}.
If the {n.en} stays {a.en}, we leave {plan}.
[Thank you|Many thanks] for the {a.en} {n.en}.
[Hello|Good evening|Dear all|Hi there|To whom it may concern|Good day],
[Hello|Good afternoon] everyone, the {n.en} is {a.en}.
[Yours faithfully|Sincerely|All the best|Talk soon|Many thanks]
Room {d2}, desk {d1}, {w} building.
Take bus {d2} to {w} station.
The [north|south] office of {w} has a {a.en} {n.en}.
Between {month} and {month} the {n.en} in {w} was {a.en}.
A {a.en} {n.en}, a {a.en} {n.en} and a {a.en} {n.en}.
I {v.en} the {n.en}, then {role} {v.en} it again.
Does {w} support {w}?
We tested {w} against {w} and the {n.en} was {a.en}.
[Both|All|Some] {n.en} files are from {w}.
It was meant to be {w}.
{role} [tested|weighed|prefers|measured] {w} [over|against|with] {w} and [saw|noted] that the {n.en} is {a.en}.
I [linked|paired|combined] {w} with {w} and [got|lost] the {n.en}.
The {n.en} and the {n.en} [stem|arrive|originate] from {w}.
They [ship|copy|import] the {n.en} from {w}.
I hope {role} {v.en} it, we hope so.
[Hope|Will|Grace|Faith] [alone|itself] does not help.
The {n.en} says {w}, I asked for {w}.
{plan} and a {a.en} {n.en} for {w}, please.
Why did {w} [lose|block|hide] the {n.en} again?
{w} should [send|fix|block] the {n.en}.
{w} never {v.en} the {n.en}.
My {n.en} [is|was] made by {w}.
The {n.en} and the {n.en} belong to {w}.
A {a.en} {n.en} and a {a.en} {n.en} [for|from|by|with|at] {w}.
We {v.en} the {n.en} [with|for|against|after] {w}.
[Compared with|Thanks to|Because of|Instead of] {w} the {n.en} is {a.en}.
{cap.w}: {w}
{cap.w}={w}
- {cap.w}: {w}
{cap.w}: {w}; {cap.w}: {plan}; {cap.w}: the {n.en} is {a.en}
{cap.w}: {role} {v.en} the {n.en} | {cap.w}: {w}
"{cap.w}": "{w}", "{cap.w}": "{order}"
{open.en}, the {n.en} is {a.en}.
{open.en}
I switched from {w} to {w} because of the {n.en}.
According to {w}, {w} is {a.en}.
{w}: {d2} of {d2} {n.en} rows are {a.en}.
{"Ref": "{order}", "Item": "{w}", "Note": "the {n.en} is {a.en}"}
"Ref": "{#}", "Note": "{a.en} {n.en} in {w}"
Note: the {a.en} {n.en} in {w}; Level: {plan}; Ref: {order}
Note: {role} {v.en} the {n.en} | Shop: {w}
Die {a.de} {n.de} aus {w} ist {a.de}.
{w} hat die {n.de} {v.de}, sagt {w}.
In {w} ist die {n.de} {a.de}.
Unser {role.de} in {w} hat die {n.de} {v.de}.
{firm} hat die {n.de} {v.de}.
[Rechnung|Auftrag|Beleg|Sendung] {order} mit {money} ist {a.de}.
Wir zahlen {money} für {plan}, die {n.de} bleibt {a.de}.
Wer hat die {n.de} {v.de}?
Seriennummer {code} passt nicht zu {w}.
Fehler {err} seit {d2} Tagen.
Nach {d2} Versuchen war die {a.de} {n.de} {a.de}.
Von {w} bis {w} dauert die {n.de} {d2} Tage.
Die {n.de} [mit|für|von|gegen|durch|bei] {w} ist {a.de}.
Ich verglich {w} mit {w}, die {n.de} ist {a.de}.
Sobald ich {w} mit {w} [benutze|koppele], ist die {n.de} {a.de}.
Bestellt war {w}, geliefert {w}.
Ich nutze die {n.de} mit {w}.
Alles geht über {w}, sogar die {n.de}.
{open.de}, die {n.de} ist {a.de}.
{open.de}
Der {role.de} meint, die {n.de} sei {a.de}.
[Guten Morgen|Liebes Team|Moin|Hallo zusammen|Servus],
[Beste Grüße|Mit besten Grüßen|Danke schön]
La {n.es} de {w} está {a.es}.
{w} muestra {err}, {w} da {err}.
{w} {v.es} la {n.es}, según {w}.
En {w} la {n.es} es {a.es}.
Nuestro {role.es} {v.es} la {n.es} {a.es}.
[Factura|Pedido|Recibo|Caso] {order} por {money}.
Pagamos {money} por {plan} y la {n.es} sigue {a.es}.
¿Quién {v.es} la {n.es} en {w}?
Fallo {err} hace {d2} días.
{firm} {v.es} la {n.es}.
La {n.es} [con|por|para|sin|tras] {w} está {a.es}.
Comparé {w} con {w}, la {n.es} es {a.es}.
Cuando uso la {n.es} {a.es} con {w}, falla.
Pedí {w}, llegó {w}.
Uso la {n.es} con {w}.
Cambié {w} por {w}.
Todo va por {w}, hasta la {n.es}.
{open.es}, la {n.es} está {a.es}.
{open.es}
Viajé de {w} a {w} por la {n.es}.
[Buenas tardes|Estimado equipo|Qué tal],
[Mil gracias|Atentamente|Saludos]
La {n.fr} de {w} est {a.fr}.
{w} affiche {err}, {w} donne {err}.
{w} a {v.fr} la {n.fr}, selon {w}.
À {w} la {n.fr} est {a.fr}.
Notre {role.fr} a {v.fr} la {n.fr} {a.fr}.
[Facture|Achat] {order} de {money}.
Nous payons {money} pour {plan}, la {n.fr} reste {a.fr}.
Pourquoi avoir {v.fr} la {n.fr} de {w} ?
Erreur {err} depuis {d2} jours.
{firm} a {v.fr} la {n.fr}.
La {n.fr} [avec|par|pour|sans|chez] {w} est {a.fr}.
J'ai comparé {w} avec {w}, la {n.fr} est {a.fr}.
Quand j'utilise la {n.fr} {a.fr} avec {w}, cela échoue.
Nous préférons {w} à {w}.
J'ai demandé {w}, voici {w}.
J'utilise la {n.fr} avec {w}.
J'ai échangé {w} contre {w}.
Tout va par {w}, même la {n.fr}.
{open.fr}, la {n.fr} est {a.fr}.
{open.fr}
De {w} à {w}, la {n.fr} met {d2} jours.
[Bonsoir|Chère équipe|Coucou],
[Merci beaucoup|Salutations|Bien à vous]
A {n.pt} de {w} está {a.pt}.
{w} {v.pt} a {n.pt}.
[Fatura|Pedido] {order} de {money}.
[Bom dia|Boa tarde|Olá],
De {n.nl} uit {w} is {a.nl}.
{w} heeft de {n.nl} {v.nl}.
[Factuur|Bestelling] {order} van {money}.
[Goedemorgen|Beste team],
{n.ru} из {w} не {v.ru}.
В {w} {n.ru} {a.ru}.
{w} выдаёт {err}, {w} выдаёт {err}.
{w} показал {err}, {n.ru} {a.ru}.
[Счёт|Заказ|Чек] {order} на {money}.
Мы платим {money} за {plan}, {n.ru} {a.ru}.
{role.ru} {v.ru} {n.ru} вчера.
Из {w} в {w} {n.ru} шла {d2} дней.
{n.ru} [от|с|для|без|после] {w} {a.ru}.
Просил {w}, привезли {w}.
Всё идёт через {w}, даже {n.ru}.
{open.ru}, {n.ru} не {v.ru}.
{open.ru}
Почему {n.ru} не {v.ru}?
[Доброе утро|Привет|Уважаемые коллеги],
[Большое спасибо|Всего доброго]
Thank you 🙂
All the best 👍🏽
{w} 🎉 {n.en}
"""

# Captions of identity numbers.
_ID_CAPTIONS = """social security number|social security no.|SSN|national insurance number|NI number|national id|national ID number|identity card|identity card number|ID card|id number|passport|passport number|passport no.|
tax id|tax number|tax identification number|TIN|driving licence|citizen number|personal number|health insurance number|Steuernummer|Steuer-ID|Ausweisnummer|Personalausweis|Reisepass|Sozialversicherungsnummer|
DNI|NIE|NIF|número de identidad|pasaporte|número de pasaporte|carte d'identité|numéro de passeport|passeport|numéro fiscal|numéro de sécurité sociale|cartão de cidadão|CPF|passaporte|BSN|paspoort|identiteitskaart|паспорт|номер паспорта|ИНН|СНИЛС""".replace("\n", "")

# Ordinary words (nouns, adjectives, verbs, people by their work) of each language.
_WORDS = {
    "n.en": "invoice parcel printer report calendar password account ticket contract menu lamp basket router manual video photo payment keyboard booking form voucher update folder screen chair survey",
    "a.en": "broken late wrong blue old empty private slow nice odd missing huge tidy blank public heavy quiet outdated perfect useless weekly new short cheap",
    "v.en": "changed deleted opened sent returned printed checked moved copied shared fixed closed lost read signed",
    "n.de": "Rechnung Lieferung Datei Bestellung Anleitung Seite Karte Lampe Tasche Nachricht Zahlung Liste Kopie Maschine Buchung",
    "a.de": "kaputt alt neu langsam leer falsch gut teuer seltsam richtig spät klein privat",
    "v.de": "geprüft geöffnet verloren bezahlt geändert verschickt gelöscht gefunden kopiert gedruckt unterschrieben",
    "n.es": "factura entrega página lámpara tarjeta copia lista caja reserva pantalla carta mesa nota compra",
    "a.es": "rota nueva vieja lenta vacía buena mala privada pequeña cara extraña corta",
    "v.es": "cambió envió perdió abrió borró pagó revisó copió firmó encontró",
    "n.fr": "facture livraison page lampe carte copie liste boîte réservation machine lettre table note commande",
    "a.fr": "cassée nouvelle vieille lente vide bonne mauvaise privée petite chère étrange courte",
    "v.fr": "changé envoyé perdu ouvert effacé payé vérifié copié signé trouvé",
    "n.pt": "fatura entrega página carta lista caixa cópia reserva",
    "a.pt": "nova velha lenta vazia boa cara estranha",
    "v.pt": "mudou enviou perdeu abriu pagou copiou",
    "n.nl": "factuur levering pagina kaart lijst doos kopie boeking",
    "a.nl": "kapot nieuw oud traag leeg goed duur vreemd",
    "v.nl": "gewijzigd verstuurd verloren geopend betaald gekopieerd",
    "n.ru": "счёт посылка страница карта лампа коробка копия заявка письмо книга",
    "a.ru": "сломан старый новый пустой плохой хороший странный потерян",
    "v.ru": "изменил отправил потерял открыл удалил оплатил проверил нашёл работает пришла",
    "open.en": "Unfortunately|However|By the way|For example|In the end|Sometimes|Please help|Kind regards|Best regards|Last but not least|As a result|Dear Sir or Madam|Good luck|Happy New Year|Customer Service|Terms of Use|Sign In|Help Center",
    "open.de": "Leider|Übrigens|Zum Beispiel|Am Ende|Manchmal|Bitte um Hilfe|Freundliche Grüße|Sehr geehrte Damen und Herren|Im Voraus danke|Guten Abend|Nach dem Umzug|Seit dem Wechsel",
    "open.es": "Lamentablemente|Por cierto|Por ejemplo|Al final|A veces|Ayuda por favor|Un cordial saludo|Buenas noches|Antes del viaje|Tras el cambio|Estimados señores|Desde el lunes",
    "open.fr": "Hélas|Au fait|Par exemple|À la fin|Parfois|Aidez-moi|Bien cordialement|Bonne journée|Avant le départ|Depuis le changement|Chers collègues|Depuis lundi",
    "open.ru": "К сожалению|Кстати|Например|В конце|Иногда|Помогите пожалуйста|С уважением|Добрый вечер|Перед отъездом|После замены|Уважаемая поддержка|С понедельника",
    "cap.name": "Name|Customer|Client|Passenger|Guest|Owner|Patient|Tenant|Subscriber|Member|Nom|Nombre|Naam|Kunde|Cliente",
    "cap.w": "Product|Model|Brand|City|Branch|Device|Company|Office|Plan|Version|Team|Place|Region|Problem|Expected|Since|Subject|Topic|Produkt|Ort|Producto|Ciudad|Produit|Ville",
    "role": "the driver|our neighbour|your manager|a technician|the receptionist|my sister|the landlord|our accountant|the clerk|a nurse|the whole team|our clients|the janitor|your agent|my boss|the director|a volunteer|the shop owner",
    "role.de": "Techniker|Nachbar|Chef|Fahrer|Vermieter|Buchhalter|Kollege|Kunde",
    "role.es": "técnico|vecino|jefe|chófer|casero|contable|cliente|colega",
    "role.fr": "technicien|voisin|chef|chauffeur|comptable|client|collègue",
    "role.ru": "техник|сосед|начальник|водитель|бухгалтер|клиент|коллега",
}

# Names of many countries that are ordinary there, so that the shapes of names are not those of one maker.
_GIVEN = """Anna Paul Maria Jan Sofia Peter Elena Lukas Ines Omar Yuki Wei Priya Ahmed Fatima Carlos Lucia Pierre Claire Hans Greta Erik Astrid Ivan Olga Dmitri Svetlana Marco Giulia
Tomasz Agnieszka Janos Katalin Andrei Ioana Sean Niamh Rhys Bronwen Kofi Ama Chidi Ngozi Thabo Zanele Mei Hiroshi Arjun Leila Hassan Noor Diego Camila Mateus Beatriz Emma Noah Liam Olivia""".split()
_FAMILY = """Schmidt Novak Kowalski Jansen Peeters Rossi Ferrari Garcia Lopez Silva Santos Dubois Moreau Johansson Hansen Nielsen Korhonen Ivanov Petrova Popescu Nagy Murphy Kelly Evans Hughes
Okafor Mensah Dlamini Tanaka Suzuki Chen Wang Kim Nguyen Patel Sharma Khan Rahman Haddad Cohen Levy Yilmaz Demir Papadopoulos Andersson Fischer Weber Becker Bakker Visser Lambert Girard Ortega""".split()
# Parts of invented words.
_STARTS = "b br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r rh s sch sh sk sl sp st str t th tr v vl w wr y z".split()
_VOWELS = "a e i o u a e i o ai au ea ee ei eu ie io ia oa oo ou ue y".split()
_MIDS = "b d f g k l m n p r s t v ll mm nn rr ss tt nd rt lm st".split()
_ENDS = " d k l m n r s t x y z ck ld ll lm n n na ra la ta o a e i is us os en er an on in sen son ski ska ova dt rg th tz ng ville ton berg".split()
_PLANS = "Basic Plus Premium Team Starter Family Business Gold Silver Duo Solo Fleet Summit Harbor Lantern".split()
_MONTHS = "January February March April May June July August September October November December".split()
_DOMAINS = "{w}.example {w}.com {w}.org {w}.net {w}.co.uk {w}.de mail.{w}.fr post.{w}.es {w}.test shop.{w}.invalid example.com".split()
_PARTICLES = "von van de del di der la dos da ten el bin".split()
_FIRMS = "{w} Ltd|{w} GmbH|{w} Inc.|{w} & {w}|{w} Group|{w} S.A.|{w} B.V.|{w} AG|{w} Logistics|{w} Bank|The {w} Company|{w} Partners|Hotel {w}|{w} Energy".split("|")
# Ordinary words that are also names.
_WORD_NAMES = "Hope June Grace Rose Mark Will Dale Page Heath Ivy Glen Reed Faith Joy April May Summer Daisy Frank Bill Jack Pat Drew Rich Penny Olive Pearl Dawn Ray Cliff".split()
# Forms of phone and identity numbers; 0 stands for a digit, A for a capital letter.
_PHONES = """+0 000 000 0000|+00000000000|+000 00 000 0000|000-000-0000|(000) 000-0000|000-0000|000.000.0000|000-000-000-0000|00000 000000|(000) 0000 0000|+00 00 0000 0000|+00 (0)0000 000000|+00 00 00000 000|0000 (00) 00000-000|
000/00000000|00.00.00.00.00|+00 0 00 00 00 00|0000 00 0000|00 00 00 00 00|+0 (000) 000-0000|+00-000-0000000|000 000 000|0000 000 000|+00 000 0000000|0 (000) 000-00-00|+0-000-000-0000|00-00000000|0000-000000|(00) 00000-0000|+00 000 000 000|000 0000 0000|+00 0000 000000""".replace("\n", "").split("|")
_IDS = """000-00-0000|000000000|000 00 0000|00000000A|00.000.000-A|AA 00 00 00 A|AA000000A|AA 000000 A|AA0000000|A00000000|0 00 00 00 000 000|0 00 00 00 000 000 00|00 000 000 000|00000000000|00000000-A|A0000000A|A-0000000-A|
000.000.000-00|00/000/00000|00 00 000000|0000 000000|000-000-000 00|AAA000000|A000000|0000000000|AAAAAA00A00A000A""".replace("\n", "").split("|")
_STREETS = "{n} {s} Street, {t} {z}|{n} {s} Road, {t}|{n} {s} Lane, Apt {d}, {t}, {z}|Flat {d}, {n} {s} Avenue, {t}|{n} {s} St, {t} {z}|{n} {s} Gardens, {t}, {A}{d} {d}{A}{A}|Unit {d}, {n} {s} Drive, {t} {z}|{n} {s} Close, {t}|Apartment {d}, {n} {s} Square, {t}|{n} {s} Way\n{t} {z}|House {d}, {s} Hill, {t}|{n} {s} Court, {t}, {z}|{n} {s} Boulevard, Suite {n}, {t}, {z}".split("|")
_STREETS += "{s}straße {n}, {z} {t}|{s}str. {n}, {z} {t}|{s}weg {n}, {z} {t}|{s}gasse {n}\n{z} {t}|{s}platz {n}, {z} {t}|{s}allee {n}, {z} {t}|{s}er Straße {n}, {z} {t}|Am {s} {n}, {z} {t}".split("|")
_STREETS += "Calle {s} {n}, {d}-B, {z} {t}|C/ {s}, {n} - {z} {t}|Avenida {s} {n}, {z} {t}|Plaza {s} {n}, {t}|Calle de {s}, {n}, {d}º, {z} {t}|Paseo {s} {n}, {z} {t}".split("|")
_STREETS += "{n}, rue de {s}, {z} {t}|{n} bis avenue {s}, {z} {t}|{n} rue {s}\n{z} {t}|{n}, boulevard {s}, {z} {t}|{n} place de la {s}, {z} {t}|{n}, allée des {s}, {t}".split("|")
_STREETS += "Rua {s} {n}, {z}-{y} {t}|Av. {s}, {n}, {t}|{s}straat {n}, {y} {A}{A} {t}|{s}laan {n}, {y}{A}{A} {t}|{s}plein {n}, {t}|ул. {s}, д. {n}, {t}|улица {s}, дом {n}, кв. {d}, {t}|Via {s} {n}, {z} {t}".split("|")


class Maker:
    """Invented values, from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.listed: set[str] = {w.lower() for w in _WORD_NAMES[: len(_WORD_NAMES) // 2]}

    def word(self) -> str:
        r = self.r
        body = r.choice(_STARTS) + r.choice(_VOWELS)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            body += r.choice(_MIDS) + r.choice(_VOWELS)
        return (body + (r.choice(_MIDS) if r.random() < 0.4 else "") + r.choice(_ENDS)).strip().capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def fill(self, pattern: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "0" else self.r.choice("ABCDEFGHKLMNPQRSTVWXYZ") if c == "A" else c for c in pattern)

    def given(self) -> str:
        x = self.r.random()
        w = self.r.choice(_WORD_NAMES) if x < 0.05 else self.r.choice(_GIVEN) if x < 0.25 else self.word()
        if self.r.random() < 0.6:
            self.listed.add(w.lower())
        return w

    def family(self) -> str:
        w = self.r.choice(_FAMILY) if self.r.random() < 0.25 else self.word()
        if self.r.random() < 0.5:
            self.listed.add(w.lower())
        return w

    def name(self) -> str:
        g, f, r = self.given(), self.family(), self.r
        initial = r.choice("ABCDEFGHJKLMNPQRSTW")
        form = r.choices(range(9), (34, 14, 10, 8, 8, 9, 8, 6, 3))[0]
        return (f"{g} {f}", g, f"{initial}. {f}", f"{g} {initial}. {f}", f"{g} {r.choice(_PARTICLES)} {f}", f"{f}, {g}", f"{g} {f}-{self.family()}", f, f"{g}-{self.given()} {f}")[form]

    def email(self) -> str:
        r = self.r
        plain = lambda w: "".join(c for c in w.lower() if "a" <= c <= "z") or "x"
        a, b = plain(self.given()), plain(self.family())
        local = r.choice((f"{a}.{b}", f"{a}_{b}{self.digits(2)}", f"{b}{self.digits(2)}", f"{a}+{plain(self.word())}", f"{a[0]}{b}", f"{b}-{a}", a, f"{a}{b}", f"{a[0]}.{b}.{self.digits(1)}"))
        domain = r.choice(_DOMAINS).format(w=plain(self.word()))
        form = r.choices(range(6), (64, 12, 6, 8, 6, 4))[0]
        dotted = {3: domain.replace(".", " [dot] "), 4: domain.replace(".", " dot "), 5: domain.replace(".", " (dot) ")}.get(form, domain)
        return local + ("@", " (at) ", " @ ", " [at] ", " at ", "(at)")[form] + dotted

    def phone(self) -> str:
        return self.fill(self.r.choice(_PHONES))

    def id(self) -> str:
        return self.fill(self.r.choice(_IDS))

    def address(self) -> str:
        r = self.r
        values = {"n": str(r.randrange(1, 250)) + r.choice(["", "", "", "b"]), "s": self.word(), "t": self.word(), "z": self.digits(5), "d": str(r.randrange(1, 60)), "y": self.digits(4), "A": self.fill("A")}
        return r.choice(_STREETS).format(**values)

    def plain(self, mark: str) -> str:
        r = self.r
        if mark in _WORDS:
            words = _WORDS[mark]
            return r.choice(words.split("|") if "|" in words else words.split())
        if mark == "idcap":
            every = _ID_CAPTIONS.split("|")
            return r.choice([c for c in every if " " not in c] if r.random() < 0.5 else every)
        if mark == "w":
            w = self.word() if r.random() < 0.92 else self.given()
            if r.random() < 0.12:
                self.listed.add(w.lower())
            return w if r.random() < 0.9 else f"{w} {self.word()}"
        if mark == "firm":
            return r.choice(_FIRMS).replace("{w}", self.word(), 1).replace("{w}", self.family())
        if mark == "low":
            return self.word().lower() + r.choice(("", "", "_", ".")) + r.choice(("", self.digits(2), "app"))
        if mark == "money":
            x = f"{r.randrange(1, 999)}.{self.digits(2)}"
            return r.choice((f"€{x}", f"${x}", f"£{x}", f"{x} EUR", x, x.replace(".", ",") + " €"))
        if mark == "order":
            return r.choice(("", "", "", self.fill("A-"), self.fill("AA-"), "#")) + self.digits(r.choice((6, 7, 8, 8, 9)))
        if mark == "code":
            return self.fill(r.choice("00000-0000-00|0-00-000|00-00-000|00000-0000-0|AA-0000-00|000-A-00|0A00 000 0000|AAA-000-000|00.000.00|0000-00-0|000000-000".split("|")))
        if mark == "err":
            return r.choice((self.fill("E-0000"), self.fill("ERR-0000"), self.fill("AAA-000"), self.fill("E000"), "0x" + self.digits(3) + r.choice("abcdef") + self.digits(2)))
        if mark == "plan":
            return r.choice(_PLANS)
        if mark == "month":
            return r.choice(_MONTHS)
        return self.digits(r.choice((7, 8, 9, 10)) if mark == "#" else int(mark[1]))


_CHOICE = re.compile(r"\[([^\[\]]*\|[^\[\]]*)\]")
_MARK = re.compile(r"\{(idcap|role(?:\.[a-z]{2})?|[nav]\.[a-z]{2}|cap\.[a-z]+|open\.[a-z]{2}|[a-z]+|d\d|#)\}")


def carriers(table: str) -> list[str]:
    """The rows of a table, with their line breaks."""
    return [x.replace("\\n", "\n") for x in table.strip("\n").split("\n") if x]


def _cased(text: str, how: int) -> str:
    return (text, text.upper(), text.lower(), text.title())[how]


def sequences(count: int, seed: int = 11, labelled: list[str] | None = None, unlabelled: list[str] | None = None) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str]]:
    """``count`` texts with their labelled spans (start, end, kind), and the invented list of names that goes with them."""
    make = Maker(seed)
    r = make.r
    good = labelled or carriers(LABELLED)
    other = unlabelled or carriers(UNLABELLED)
    kinds = {"name": make.name, "email": make.email, "phone": make.phone, "id": make.id, "address": make.address}
    out, deck = [], []
    for _ in range(count):
        text, spans = "", []
        how = r.choices(range(4), (82, 6, 7, 5))[0]
        for _ in range(r.choice((1, 2, 2, 3))):
            if not deck:
                deck = good[:]
                r.shuffle(deck)
            rows = [deck.pop()] if r.random() < 0.8 else []
            rows += [r.choice(other) for _ in range(r.choice((0, 1, 1, 2)))]
            r.shuffle(rows)
            style = r.choices(("asis", "lower value", "upper value"), (80, 12, 8))[0]
            for row in rows:
                if text:
                    text += r.choices((" ", "\n", " | ", "; "), (80, 10, 5, 5))[0] if not text.endswith("\n") else ""
                row = _CHOICE.sub(lambda m: r.choice(m[1].split("|")), row.replace("[{idcap}]", "{idcap}"))
                at = 0
                for m in [*_MARK.finditer(row), None]:
                    text += row[at : m.start() if m else len(row)]
                    if m is None:
                        break
                    at, mark = m.end(), m[1]
                    if mark in kinds:
                        value = kinds[mark]()
                        value = value.lower() if style == "lower value" and mark == "name" else value.upper() if style == "upper value" and mark in ("name", "email") else value
                        spans.append((len(text), len(text) + len(value), mark))
                        text += value
                    else:
                        value = make.plain(mark)
                        text += value[:1].upper() + value[1:] if m.start() == 0 and mark[0] in "nr" else value
        cased = _cased(text, how)
        out.append((cased if len(cased) == len(text) else text, spans))
    return out, make.listed
