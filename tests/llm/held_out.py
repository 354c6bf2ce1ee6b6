"""Sentences of the tables under test, with their items marked: the tagger is tested on them and never trained on them."""

LABELLED = """
My name is {name}.
I spoke with {name} about this.
Please ask for {name}, I am out today.
The parcel was left with {name}.
{name} here, following up.
Dr. {name} signed it.
Mr {name} from the depot called twice.
Mrs {name} from the office wrote back.
Ms {name} knows more.
Herr {name} weiß Bescheid.
Frau {name} weiß Bescheid.
Mein Name ist {name}.
Ich heiße {name}.
Bitte nach {name} fragen.
Me llamo {name}.
Pregunten por {name}.
La señora {name} lo firmó.
El señor {name} lo sabe.
Je m'appelle {name}.
Demandez {name}.
Madame {name} est au courant.
Monsieur {name} est au courant.
Mme {name} est au courant.
Meu nome é {name}.
Mijn naam is {name}.
Меня зовут {name}.
Спросите {name}.
Our contact {name} is away.
The technician, {name}, came late.
Contact: {name}
Name: {name}
name={name}
Customer: {name}
Regards,\n{name}
Kind regards\n{name}
Best,\n{name}
Viele Grüße\n{name}
Mit freundlichen Grüßen\n{name}
Un saludo,\n{name}
Cordialement,\n{name}
Thanks,\n{name}
-- \n{name}
— {name}
— {name}\nRegards,\n{name}
{name} <{email}>
<{email}>
You can reach me at {email}.
Send the copy to {email} please.
Write to {email}, not to the shop.
My login is {email}
cc {email}
Mail: {email}
E-mail: {email}
mail={email}
Sie erreichen mich unter {email}.
Kopie bitte an {email}
Mi correo es {email}.
Copia a {email}
Mon adresse est {email}.
Copie à {email}
Мой адрес {email}.
Копию на {email}
Call me on {phone}.
My number is {phone} after six.
Text {phone} instead.
Ring {phone} when the courier leaves.
tel: {phone}
Tel. {phone}
Tél. {phone}
Phone: {phone}
phone={phone}
Mobile: {phone}
Rufen Sie {phone} an.
Meine Nummer ist {phone}.
Llamen al {phone}.
Mi teléfono es {phone}.
Appelez le {phone}.
Звоните {phone}.
Мой номер {phone}.
Fax {phone}
You still store {id} as my social security number.
You still store {id} as my passport.
You still store {id} as my national id.
You still store {id} as my DNI.
You still store {id} as my tax number.
My SSN is {id}.
My tax id is {id}.
My identity card is {id}.
My passport number is {id}.
My national insurance number is {id}.
I typed {id} (SSN) and it failed.
I typed {id} (tax id) and it failed.
I typed {id} (social security no.) and it failed.
I typed {id} (identity card) and it failed.
I typed {id} (passport) and it failed.
Social security number: {id}
social security no.: {id}
SSN: {id}
ssn={id}
National insurance number: {id}
NI number: {id}
national id: {id}
Identity card: {id}
DNI: {id}
passport: {id}
Passport number: {id}
tax number: {id}
Tax id: {id}
Meine passport number lautet {id}.
Meine Steuernummer ist {id}.
Mein identity card ist {id}.
Mon social security number est {id}.
Mon numéro de passeport est {id}.
Mi DNI es {id}.
Mi national id es {id}.
Мой паспорт {id}.
I moved to {address}
I live at {address}.
We are at {address}, second gate.
The old address was {address}.
Deliver to {address}.
Ship it to:\n{address}\n
Address: {address}
address={address}
Ich wohne {address}.
Ich wohne in der {address}
Neue Anschrift: {address}
Unsere Adresse ist {address}.
Vivo en {address}
Mi dirección es {address}.
J'habite {address}
Notre adresse est {address}.
Мой адрес: {address}
Send it to {address}, please.
Tél. : {phone}
Tel: {phone}
Meine Nummer (tax id): {id}.
Meine Nummer (passport): {id}.
Meine Nummer (social security no.): {id}.
{id} ist falsch gespeichert.
national insurance number {id} ist falsch gespeichert.
social security no. {id} ist falsch gespeichert.
SSN {id} est mal enregistré.
Lieferung an {address}.
Entreguen en {address}
Livrez au {address}
Lever af aan {address}
{name} here again.
Hi, {name} here, following up.
Hello team, {name} here, following up.
Thanks. {name} here, following up.
"Mail": "{email}", "Product": "{w}"
"Name": "{name}", "Plan": "{plan}"
"Phone": "{phone}", "Order": "{order}"
"Address": "{address}", "Office": "{w}"
"SSN": "{id}", "Order": "{order}"
{"Name": "{name}", "Office": "{w}"}
Name: {name} | Plan: {plan} | Product: {w}
Product: {w}; Name: {name}; Plan: {plan}
Office: {w} | Name: {name} | Order: {order}
Address: {address}; Name: {name}; Office: {w}
Name: {name}; Address: {address}; Phone: {phone}
Name={name}; Product={w}; Order={order}
- Name: {name}
cc {email} {w} charged {money} twice.
Ring {name} or write to {email}.
"""

UNLABELLED = """
{w} charged {money} twice and nobody answered.
{w} charged {money} twice and the file was corrupt.
Our handle is @{low}.
Write to @{low} about it.
Ticket #{#}, batch {code}.
Serial {code} is on the back.
Tracking 1Z {d3} {d4} never moved.
Invoice {#} is fine.
Room {d2}, floor {d1}, hall {d2}.
The page {w} build 10.{d2}.{d2}.{d1} shows it.
The hotfix of 20{d2}-0{d1}-{d2} at 09:{d2} helped.
Install lib@{d2}.{d2}.{d1} first.
Hope the {month} figures reach you.
Hope is all we have.
I hope someone can close the private ticket, because the trainee waits since Friday.
Version {d2}.{d2} of {w} makes the public filter sharp.
Order {order} arrived since noon but the old lamp was odd.
The refund of {money} for order {order} is still missing since May.
Every time I open the public chart, error {err} appears and it logged me out.
We need {d2} seats on {plan} and a shared report for {w}.
Our {plan} contract mentions a weekly menu, not a draft label.
Could you print {d2} copies of the weekly form for our bookkeeper?
My weekly list shows {d2} entries, yet the courier counts {d2}.
It took {d2} tries to share the weekly menu from {w}.
In {w} the weekly menu costs {money}, here it costs {money}.
For {money} a month I'd expect the weekly menu to be less odd.
We were billed {money} for the weekly menu although my sister never opened it.
The label on the weekly basket reads {order}, which is odd.
Since we moved to the {w} branch, the weekly basket is odd.
Nothing in {w} explains why the weekly basket was copied.
Why does {w} copy the weekly basket when I only wanted to close the shared form?
The {w} app froze since Monday while the night shift tried to open the draft form.
Our reseller compared {w} with {w} and found the weekly basket odd.
The odd weekly basket and the tidy shared form both came from {w}.
Thanks to our landlord the weekly basket is now odd and the shared form too.
Support told the courier to share the weekly basket; instead the chat closed itself.
If the weekly basket stays odd, my manager will leave the {plan} plan.
After I opened the weekly basket, the screen went white and the choir had to close it by hand.
Somebody closed my weekly basket last night and I can't open it.
Honestly, the weekly basket is odd, but the shared form is tidy.
Don't close the weekly basket until the shared form has been opened.
Is there a way to open the weekly basket without touching the shared form?
I tried to close the weekly basket since May and the page stayed empty.
I do not understand how the weekly basket and the shared form belong together.
Please close the weekly basket before the clinic needs the shared form again.
The weekly basket in {w} has been odd since Easter.
The choir closed the weekly basket over the weekend, then the total changed twice.
The front desk says the weekly basket looks odd next to the shared form.
Please advise.
Any update?
Thanks.
Cheers!
Kind regards
Hello team,
Dear support,
Good morning,
Hey there,
Hi,
Product: {w}
Office: {w}
Plan: {plan}
New plan: {plan}
Order: {order}
order={order}
Product={w}
Since: after the {month} update
Problem: The weekly basket in {w} has been odd since Easter
Expected: We need {d2} seats on {plan} and a shared report for {w}
Sehr geehrte Damen und Herren,
Guten Tag,
Hallo,
Danke im Voraus.
Mit freundlichen Grüßen
Die Nummer {order} steht auf dem Karton, doch das alte Paket fehlt.
Beleg {order} über {money} nennt {w}, gekauft war {w}.
Filiale {w}: die alte Liste langsam, das neue Paket gut, Vorgang {order}.
Tarif {plan} kostet in {w} genau {money}, sagt {w}.
Seit Montag kann ich das alte Paket in {w} nicht mehr öffnen.
Gerät {w} kam aus {w} ohne das alte Paket.
Unsere Kollegin aus {w} hat das alte Paket gestern erhalten und findet alles gut.
Der Techniker aus {w} tauschte {w} gegen {w}.
Umzug von {w} nach {w}: das alte Paket bitte übernehmen.
Zwischen {w} und {w} ging Sendung {order} verloren.
Nach dem Wechsel auf {w} war das alte Paket plötzlich leer.
Wenn das alte Paket nicht bald kommt, kündigen wir den Vertrag für {w}.
{w} meldet Fehler {err}, {w} dagegen {err}.
Ab {w} läuft alles über {w}, auch das alte Paket.
Code {err} erscheint, sobald ich das alte Paket mit {w} verbinde.
Ich habe das alte Paket {d2} Mal gesucht, aber {w} zeigt nur die alte Liste.
Von {d2} Plätzen im Tarif {plan} sind nur {d2} sichtbar.
Für {money} im Monat erwarte ich, dass das alte Paket nicht so leer ist.
Buenos días,
Hola,
Un saludo
Gracias de antemano.
El número {order} aparece en el paquete, aunque falta la lista nueva.
El recibo {order} de {money} nombra {w}, pero compré {w}.
Oficina de {w}: la lista nueva vacía, la caja rota, caso {order}.
Desde {w} todo pasa por {w}, incluso la lista nueva.
Entre {w} y {w} se perdió el envío {order}.
El técnico de {w} cambió {w} por {w}.
Aparato {w} llegó de {w} sin la lista nueva.
Plan {plan}: {money} en {w} según {w}.
Nuestra compañera de {w} recibió la lista nueva ayer y la encuentra vacía.
He buscado la lista nueva {d2} veces, pero {w} solo muestra la caja.
{w} marca {err}, mientras {w} indica {err}.
De {d2} plazas del plan {plan} solo veo {d2}.
Si la lista nueva no llega pronto, dejaremos {w} para siempre.
Bonjour,
Madame, Monsieur,
Cordialement
Merci d'avance.
Le numéro {order} figure sur le colis, pourtant il manque la liste.
Le reçu {order} de {money} cite {w}, mais c'était {w}.
Agence de {w} : la liste vide, la boîte abîmée, dossier {order}.
Entre {w} et {w}, le colis {order} a disparu.
Le technicien de {w} a remplacé {w} par {w}.
À {w}, tout passe désormais par {w}, même la liste.
Forfait {plan} : {money} à {w} selon {w}.
Notre collègue de {w} a reçu la liste hier et trouve cela vide.
J'ai cherché la liste {d2} fois, mais {w} affiche seulement la boîte.
Sur {d2} places du forfait {plan}, seules {d2} apparaissent.
Après le passage à {w}, la liste était soudain vide.
Appareil {w} reçu de {w} sans la liste.
Si la liste n'est pas modifiée bientôt, nous quittons {w}.
Чек {order} на {money} называет {w}.
Тариф {plan} стоит {money} в {w}.
Прибор {w} пришёл из {w} без коробки {order}.
Мастер из {w} заменил {w} на {w}.
Между {w} и {w} потерялась посылка {order}.
Коллега из города {w} получил старый список вчера.
Из {d2} мест тарифа {plan} видно {d2}.
The store manager, the courier and our bookkeeper were there.
Our partner {w} Ltd sent {d2} boxes.
My sister lives in {w}.
The {w} Group moved its office to {w}.
С уважением
С уважением,
Здравствуйте,
Добрый день,
Заранее спасибо.
К сожалению, старый список оказался пустой, и никто не отвечает.
Почему старый список снова удалён, если мы заплатили {money}?
Если старый список не будет готов, мы уйдём из {w}.
Я искал старый список {d2} раз, но {w} показывает только новый.
{w} пишет {err}, а {w} пишет {err}.
Филиал {w}: старый список пустой, новый файл готов, заявка {order}.
После перехода на {w} наш список стал пустой.
Код {err} при запуске {w}.
Вместо {money} списали {money}, чек {order}.
Объясните, как связаны старый список и новый файл?
Проверьте, пожалуйста, был ли старый список удалён.
Спасибо, старый список был удалён, и всё снова работает.
Уже три дня не могу открыть старый список в {w}.
Kind regards 👨‍👩‍👧
Thanks. 🙏🏽
Cheers! 👩‍💻
Any update? 🇳🇱
Please advise. ⚠️
Thanks. 🙂
Danke im Voraus. 👩‍💻
Gracias de antemano - 👨‍👩‍👧
{"Order": "{order}", "Product": "{w}", "Plan": "{plan}", "Expected": "The weekly basket in {w} has been odd since Easter"}
"Order": "{d6}", "Expected": "{w} charged {money} twice and nobody answered"
"Product": "{w}"}
"Office": "{w}", "Problem": "We need {d2} seats on {plan} and a shared report for one technician"}
Malheureusement la liste est vide et personne ne nous répond.
Por desgracia la caja está rota y nadie nos contesta.
Leider ist das alte Paket leer und niemand meldet sich bei uns.
Merci de vérifier si la liste a bien été modifiée.
Les ruego comprobar si la caja fue modificada de verdad.
"""
