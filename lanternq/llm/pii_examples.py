"""The small labelled table of problem 5: sentences whose {name}, {email}, {phone}, {id_number} and {address} slots are labelled, and
sentences that only resemble them. They are written for this table, from everyday letters, forms and notes; a test checks that none of
their fixed parts stands in the test tables. A seeded generator fills the slots with invented values."""

from __future__ import annotations

import random

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")

LABELLED = r"""
The landlord, {name}, keeps a spare key at {address}.
Rent is due on the first; transfer it to {name} and text {phone} once done.
Tenant {name} ({email}) gave notice for the flat at {address}.
Our choir rehearses at {address} every {day}, newcomers ring {phone}.
Soprano parts are with {name}; altos write to {email}.
Patient: {name}, born {date}, lives at {address}, {place}
Patient {name} was seen by Dr. {name} on {date} and is doing well.
Next of kin {name}, telephone {phone}
Blood results go to {email} only, never by post.
Nurse {name} called back from {phone} but nobody picked up.
Prescription for {name}, insurance number {id_number}, two tablets a day.
Mrs. {name} lost her purse near the station; finder please dial {phone}.
Pupil {name} will be late on {day}, signed {name}.
Parents of {name} can be reached under {phone} or {phone}.
Class trip forms go back to Ms {name} by {date}.
Homework may be sent to {email} until {time}.
The head of school, {name}, lives around the corner at {address}.
Passenger {name}, passport no. {id_number}, seat {n2}C
Travel document {id_number} expires in {month}, renew it before the flight.
Passport number: {id_number}
her passport is {id_number} and mine is {id_number}
The visa was stamped into passport {id_number} issued to {name}.
Booking made by {name}, e-mail {email}, mobile {phone}
Please pick me up at {address} at {time}, I will wait outside.
Driver {name} parked in front of {address} and got a ticket.
Driving licence {id_number} belongs to the man who hit my bike, {name}.
Witness statement of {name}, residing at {address}, {place} {postcode}
The claimant ({name}) and the defendant ({name}) met on {date}.
Solicitor: {name} / {phone} / {email}
We sold the house at {address} to {name} for {amount}.
Keys for {address} are in the safe, code {n4}.
Send flowers to {name}, {address}, {place}.
A parcel for {name} was left with the neighbour at {address}.
Deliver to:
{name}
{address}
{postcode} {place}
Sender:
{name}
{address}
Invoice address {address}, {postcode} {place}; contact person {name}.
Goalkeeper {name} and captain {name} both signed for another year.
The coach said {name} will miss the match in {place}.
Winner of the {n2} km run: {name} in {time}
Referee {name} stopped play twice.
I sat next to {name} at dinner and we talked about {place}.
Yesterday {name} told me that {name} is getting married.
have you heard from {name} lately
According to {name}, the bakery closes in {month}.
{name} wrote the song, {name} sang it.
{name} says hello and hopes to see you soon.
A cake for {name} please, with {n2} candles.
Photo taken by {name} in {year}.
Text and pictures: {name}
Translated from the original by {name}
Interview with {name} about gardens, page {n2}
Author {name} reads from a new novel on {day}.
Donation of {amount} by {name} received, thank you letter goes to {address}.
Account holder {name}, tax number {id_number}
Taxpayer {id_number} still owes {amount} for {year}.
His social security no. {id_number} is wrong in your file.
SSN: {id_number}
ssn {id_number}, dob {date}
NI number {id_number} applies from {month} on.
National ID {id_number} was scanned at the counter.
Her identity card ({id_number}) was found in the park.
Personnummer {id_number} saknas i ansökan från {name}.
Please note my new identity number {id_number}, the old one is void.
The citizen with ID {id_number} moved to {address} in {year}.
The form wants a social insurance number, mine is {id_number}.
Residence permit {id_number} holder: {name}
To whom it may concern, {name} holds ID card {id_number}.
Identification: {id_number}; applicant: {name}; street: {address}
applicant {name}, address {address}, phone {phone}, id {id_number}
name={name};street={address};tel={phone}
"name": "{name}", "mail": "{email}", "ssn": "{id_number}"
name: {name}
e-mail: {email}
tel: {phone}
{name},{email},{phone},{place}
{name}; {address}; {phone}
{name} | {email} | {date}
{name} - {phone}
<td>{name}</td><td>{email}</td><td>{phone}</td>
[{time}] {name}: are you there?
{name} wrote on {date} at {time}:
On {date}, {name} <{email}> wrote:
To: {name} <{email}>; {name} <{email}>
Cc: {email}
From: {email}
sent from {email} to {email}
mailto:{email}
My address changed from {email} to {email}.
Questions? {email} answers within a day.
Write to {email} if you want a seat.
you can drop me a line at {email}
Unsubscribe {email} from the list, please.
The mailbox {email} bounced {n2} times.
login {email} was locked at {time}
I forgot the password for {email}, can it be reset?
Phone: {phone}
Call me: {phone}
ring {phone} after {time}
Text STOP to {phone} to leave.
WhatsApp {phone}, evenings only
Our number is {phone} and the fax is {phone}.
The doorbell is broken, so phone {phone} when you arrive.
In an emergency dial {phone} and ask for {name}.
office {phone}, home {phone}
my cell is {phone} call any time
You missed a call from {phone} at {time}.
reachable via {phone} until {day}
I am on holiday; {name} ({phone}) covers for me.
Yours sincerely,
{name}
Yours faithfully
{name}
{phone}
Cheers,
{name}
Warm wishes from {name}
Love, {name}
See you on {day}, {name}
Thank you for your help. {name}, {role}
Signed: {name}
Dear {name},
Dear Mr. {name}, your table is booked for {time}.
Hello {name}, the plumber comes on {day}.
Hi {name}, any news about the piano?
Attn. {name}, {role}
Hired: {name} as {role} from {date}.
Our {role} {name} retires in {month}.
The {role}, {name}, is on leave until {date}.
We welcome {name}, who joins us as {role}.
Shift swap between {name} and {name} is fine with me.
{name} has left; give the desk to {name}.
The laptop of {name} was stolen from {address}.
I, {name}, confirm that I got the keys for {address}.
this is {name} from {place}, please call {phone}
my name is {name} and i live at {address}
I'm {name}, the new {role}.
They live at {address} now.
We are moving to {address} in {month}.
The shop on the corner, {address}, opens at {time}.
Meet us at {address}.
Fire reported at {address}, two engines sent.
The meter at {address} shows {n5}.
Plot next to {address} is for sale.
visit us: {address}, {place}
Home visits: {address} at {time}, {address} at {time}.
Ich wohne jetzt in der Nähe, {address}, {postcode} {place}.
Herr {name} ist unter {phone} zu erreichen.
Frau {name} zieht um nach {address}.
Bitte schreiben Sie an {email} oder rufen Sie {phone} an.
Mit herzlichem Gruß {name}
Madame {name} habite au {address}.
Veuillez appeler {name} au {phone}.
Mon adresse est {address} et mon courriel {email}.
La señora {name} vive en {address}.
Mi correo es {email} y mi teléfono {phone}.
Il signor {name} abita in {address}.
Mevrouw {name} belt u terug op {phone}.
{w} {w} {name} {w} {w} {w}.
{W} {w} {w}, {name}.
{w} {w} {w} {name} {w} {name}
{name} {w} {w} {w}, {w} {w}.
{W} {w} {name}, {w} {w} {w} {name}; {w}
{W} {W}: {name}
{W}: {name}
{w}: {name}, {w} {w}
({name}) {w} {w}
{W} {w} {address} {w} {w}.
{w} {w} {w}, {address}
{W}: {address}
{W} {w} {w} {address}, {w} {w}; {address}.
{w} {w} {email} {w} {w}
{W}: {email}
{W} {w} {w} {phone}, {w}.
{W}: {phone}
{w} {w} {phone} {w} {phone}
Government record {id_number} of {name} was updated.
His state pension number {id_number} stands on every letter.
What is your social security number? {id_number}
Proof of identity: passport {id_number} or licence {id_number}
Driver's license {id_number} was found on the floor.
The passport ({id_number}) is in the drawer.
Her tax ID is {id_number}, his is {id_number}.
My SSN {id_number} was printed on the envelope.
A copy of ID card {id_number} is attached.
Birth number {id_number}, sex F
The insured person has national insurance number {id_number}.
Enter national insurance number: {id_number}
social security: {id_number}
Someone used my social security number {id_number} for a loan.
Personal identity number {id_number} has a typo.
personal id {id_number} of the applicant
passport={id_number}
Passport of {name}: {id_number}
Citizen service number {id_number} ends in the wrong digit.
The permit shows ID number {id_number} and the street {address}.
Identity document no {id_number}, valid until {month} {year}
New passport {id_number} replaces {id_number}.
Frau {name} und Herr {name} haben den Schlüssel.
Herr {name} wohnt in der {address}.
Die Vermieterin {name} ist bis {day} verreist.
Gruß, {name}
Liebe Grüße von {name}
Ansprechpartner: {name}, Telefon {phone}, {email}
Sehr geehrter Herr {name}, vielen Dank für Ihren Brief.
Madame {name} et Monsieur {name} arrivent {day}.
Cordialement, {name}
Merci de livrer chez {name}, {address}.
Monsieur {name}, {address}, {postcode} {place}
Il habite {address} depuis {year}.
Señor {name}, su pedido está listo.
Atentamente, {name}
El nuevo domicilio es {address}, {place}.
La signora {name} e il signor {name} aspettano in {address}.
Cordiali saluti {name}
De heer {name} woont op {address}.
Med vänlig hälsning {name}
Jag bor på {address} i {place}.
next of kin is {name}, captain of the team
Captain {name} and sergeant {name} led the search.
Prof. {name} and Dr {name} wrote the report.
Miss {name} plays the harp; Sir {name} listens.
Aunt {name} and uncle {name} send their love.
Baby {name} was born on {date}, mother {name}
My brother {name}, my sister {name} and I share a car.
His wife {name} works at the post office.
Our neighbour {name} feeds the cat.
A friend of mine, {name}, lost the keys.
Tell {name} that the soup is ready.
Give it to {name} or to {name}.
Where is {name}?
Is {name} coming on {day}?
Who knows {name} from {place}?
We thank {name}, {name} and {name} for the music.
{name} and {name}
{name}, {name}, {name}
{name} ({place})
{name} / {name}
- {name}
* {name}, {phone}
{n1}. {name}
{n1}. {name}, {n2} points
Name: {name} Date: {date} Place: {place}
Guest: {name}, room {n3}, {n1} nights
Buyer: {name}
Seller: {name}, {address}
Owner {name}, chip {n10}
Caller {name} did not leave a message.
Reported by {name} at {time}
Approved by {name} on {date}
Assigned to {name}; watcher {name}
created by {name}, closed by {name}
owner={name} role={word}
user {name} logged out at {time}
Regards {name} {role}
Best, {name}
Sincerely, {name}, {role}, {place}
Talk soon - {name}
thanks and bye {name}
{name} here, the line was cut.
it was {name} who found the ring
{name} can't come because of the snow.
{name} will drive and {name} brings the cake.
The dog of {name} barked at {name}.
In {year} {name} opened a shop at {address}.
The old school ({address}) became a hotel.
Turn left at {address} and stop.
The bus stops in front of {address}.
Lives at {address}; works at {address}.
Street: {address}
Home address: {address}, {postcode} {place}
Ship to {address} by {day}.
{address}
{address}, {place}
{address}, {postcode} {place}, {phone}
Burglary at {address} on {date}
The flat is on the second floor of {address}.
The plumber went to {address} by mistake.
House for rent, {address}, {amount} a month
new address from {month}: {address}
My SSN is {id_number}.
the passport {id_number} is expired
nino {id_number}
What do you mean, {id_number} is not my social security number?
Her national insurance no. {id_number} was copied by hand.
The ID number {id_number} is mistyped on the payslip of {name}.
Taxpayer {id_number}, taxpayer {id_number}
Der Ausweis {id_number} ist abgelaufen.
Numéro de passeport {id_number}
The ID check used {id_number}.
identity check: {id_number}, {address}
ID check failed for {id_number}.
checked ID {id_number} against the list
Callback: {phone}
call back on {phone}
Please use the callback number {phone} from {time} on.
contact number {phone}, contact name {name}
number: {phone}
Tel: {phone} | Name: {name}
Tel {phone} / Mobile {phone}
mobile: {phone}
Cell {phone}, landline {phone}
you can text my mobile, {phone}
the number is {phone}
her new number is {phone}
Phone numbers: {phone}, {phone}
{name}, {role}, {phone}
{role} {name}: {phone}
tel. {phone}, mail {email}
Telephone: {phone} (day), {phone} (night)
SSN on file: {id_number}
SSN {id_number}, passport {id_number}
Licence number {id_number} was issued to {name}.
driving license no. {id_number}
The identity card {id_number} expired.
Identity number: {id_number}
Insurance number of the patient: {id_number}
personal number: {id_number}
Personal number of {name}: {id_number}
Tax number {id_number} or tax ID {id_number}
taxpayer number {id_number} is missing
Residence permit no. {id_number}
travel document no. {id_number}
Passport {id_number} and visa were checked.
ID: {id_number}
id no. {id_number}
Identification number {id_number}, born {date}
identification {id_number}
Identity document: {id_number}
Social insurance {id_number}
citizen number {id_number}
ID checked: {id_number}, phone {phone}
The clerk did an ID check with {id_number} and found {address}.
Check of ID {id_number} done
Identified by {id_number}, {name}
The man showed ID {id_number}.
{id_number} is my social security number.
{id_number} is the passport of {name}.
{phone} is my number.
{phone} is the new number of {name}.
Landline {phone}, mobile {phone}
Phone {phone} or {phone}
phone no. {phone}
tel no {phone}
"""

RESEMBLING = r"""
Gasket {ssnlike} is out of stock, use {ssnlike} instead.
Catalogue no. {ssnlike}, box of {n2}, {amount} each
Lot {phonelike} failed the drop test.
Article {phonelike} comes in red and blue.
Parcel number {n10} left the depot at {time}.
Shipment {n12} is held at customs in {place}.
Order {ref} from {date} is on its way.
Our order number is {n8}, yours is {ref}.
Invoice {ref} over {amount} was paid on {date}.
Cheque {n7} bounced.
Customer number {n8} has no open items.
Member no. {n6}, valid until {month} {year}
Employee badge {n6} stopped working.
Library card {n10} is blocked, fee {amount}.
Policy {ref} covers water damage up to {amount}.
Serial {code}, built in {year}
Model {code} replaces {code}.
The part fits {code} and {code} only.
ISBN {isbn}, {n3} pages
EAN {n13}, shelf {n2}
Coordinates {n2}.{n5}, {n2}.{n5}
The sensor at {n2}.{n4} north reported {n2}.{n1} degrees.
Meter {n8} shows {n6} kWh, last year {n6}.
Odometer {n6}, next service at {n6}.
We scored {n2}-{n2}, then {n2}-{n2}, then lost.
Size {n2} x {n2} x {n3} mm, weight {n2}.{n1} kg
Page {n2} of {n3}, see table {n1}.{n1}
Chapters {n1}-{n2} are about {place}.
Section {n1}.{n1}.{n1} was removed in {year}.
Version {version} fixes the crash, {version} brings it back.
Update from {version} to {version} took {n2} minutes.
ping {ip} works, {ip} does not
Route {ip} via {ip} metric {n3}
MAC {mac} got {ip} from the router.
build {hex8}{hex8} passed
Checksum {hex8} does not match {hex8}.
Error {code} at line {n3}, column {n2}
Exit code {n3} after {n4} ms
{date8}T{time}:{n2} INFO {word} started in {n4} ms
{date8} {time} WARN {word}.{word}: retry {n1} of {n1}
id={n8} size={n6} state=ok
npm install {word}@{version}
pip install {word}=={version}
Image {word}:{version} pulled from {word}.{word}/{word}
ssh root@{word} and run the script
Follow @{word} and @{word}{n2} for news.
cc @{word} please review
Tag the photo with #{word}{n2} @ {place}
Tickets @ {amount}, children @ {amount}
See {url} for the timetable.
Open {url} and click the second link.
C:\{word}\{word}_{n3}.txt is empty.
/var/log/{word}/{word}-{n4}.log grew to {n3} MB
Save it as {word}_{n4}.pdf, not {word}.docx.
Flight {code} leaves gate {n2} at {time}.
Train {n4} to {place} is {n2} minutes late.
Platform {n1}, coach {n2}, seat {n2}
Bus {n2} runs every {n2} minutes between {place} and {place}.
Room {n3}, floor {n1}, turn left twice.
Hall {n1} seats {n3} people.
Extension {n4} is engaged all morning.
dial {n3} from any desk for the porter
Press {n1} for sales, {n1} for support.
PIN {n4} was entered {n1} times.
The one time code is {n6}.
Postcode {postcode} is {place}, {postcode} is not.
{postcode} {place}, {month} {year}
{place}, {date}
{amount} plus {n2} per cent tax makes {amount}.
Balance {amount}, last payment {amount} on {date}
The bank account {n10} at sort code {n2}-{n2}-{n2} is closed.
Channel {n2}, volume {n2}, bass {n1}
{n1} Way Valve, {n2} Bar, {n1} Inch Thread
{n2} Row Seeder with {n1} Point Hitch
{n1} Door Cabinet and {n1} Drawer Chest, {place} range
{n2} Port Hub, {n1} Slot Tray, {n2} Pin Plug
{n1} Lane Bridge closed, {n1} Lane Road stays open
{n2} Hour Drive with {n1} Stops
{n1} Court Hall, {n2} Place Setting, {n1} Square Tiles
We need {n2} seat cushions and {n1} way adapters by {day}.
The {n1} lane road to {place} is shut.
{n2} drive belts and {n2} close fit bolts
Turn into the second street after the bridge.
The avenue was lined with lime trees.
Station Road is closed, use the ring road.
There is no parking in Mill Lane after {time}.
{cap} Street station reopens in {month}.
Dear all, the lift is out of order.
Dear {team}, nobody answers the door.
Dear neighbours, the bins go out on {day}.
Hello everyone, lunch is at {time}.
Hi {given}, did you get my note?
Thanks, {given}
{given} is three years old and likes trains.
{given} and {given} are at the beach.
Ask {given} or {given} for the ladder.
Mr {family} left early.
Mrs {family} and Dr {family} share a practice.
The {family} family moved away in {year}.
Regards from {team}
Kind greetings, {team}
Yours, {team}
With thanks from {team} in {place}
Signed on behalf of {team}
Contact {team} before {date}.
{team} and {team} swapped floors.
The {thing} belongs to {team}.
{team} reported it, {team} closed it.
Written by {team}, checked by {team}
Ask {team} about {ref}.
{product} is faster than {product}.
{product} {version} needs a restart of {product}.
Install {product}, open {product} and log in.
The {product} licence ends in {month}.
Is {product} down again?
{title}
{title}: {title}
{title} - {title}
1. {title} 2. {title} 3. {title}
Click {title}, then {title}.
The page "{title}" cannot be found.
The film {title} starts at {time}.
Chapter {n1}: {title}
Subject: {title}
Re: {title}
Attachment: {title}.pdf
Menu > {title} > {title}
The button says {title} but nothing happens.
The {cap} project ends in {month}.
{cap} is a town, not a brand.
{place} and {place} are an hour apart.
We flew from {place} to {place} via {place}.
{place} City beat {place} United {n1}:{n1}.
Bank of {place}, branch {n3}
University of {place}, Faculty of Law
Hotel {cap}, {place}, {n1} stars
Saint {given} church is being painted.
{cap} Ltd and {cap} GmbH merged.
The {cap} Group sold {cap} Foods for {amount}.
Lake {cap} is frozen, Mount {cap} is not.
{month} was cold, {month} will be warm.
{day} to {day}, {time} to {time}
Closed on {day} and {day}.
Will the rose bush survive the frost?
Mark the date, bill the guest and chase the rest.
Grace was said, then hope returned with joy.
May I ask when the art class starts?
In June the lily pond is full.
Frank talk and rich food
the old oak and the young ash fell over
i think the soup needs salt
no idea why the screen went dark
please water the plants while we are away
could someone feed the cat on {day}
nobody told us about the new rules
the {thing} makes a noise
A {role} needs a {thing} by {day}.
The {role} asked the {role} for help.
Our {thing} was repaired twice in {year}.
Two of the {n2} chairs are broken.
We waited {n2} minutes at the {thing}.
The {thing} in room {n3} is mine.
Minutes of the meeting of {date}: budget, roof, summer fair.
Agenda: 1. Welcome 2. Report of the {role} 3. Any other business
Notice: doors close at {time} sharp. Latecomers use the side entrance.
This letter was printed by machine and is valid without a signature.
Confidential. For the reader's eyes only.
All prices include tax. Offer ends {date}.
Terms and Conditions apply. No refunds.
Ingredients: flour, sugar, butter, {n2} g salt
Stir for {n2} minutes at {n3} degrees.
Der Aufzug ist seit {day} außer Betrieb.
Die Sitzung am {date} fällt aus, neuer Termin folgt.
Rechnung {ref} vom {date} über {amount}
Guten Tag, das Gerät {code} startet nicht mehr.
Viele Grüße vom ganzen Team
Le magasin ferme à {time} le {day}.
La facture {ref} du {date} reste impayée.
Bonjour à tous, la salle {n3} est réservée.
El tren de {place} llega a las {time}.
La factura {ref} suma {amount}.
Hola a todos, mañana no hay clase.
Il negozio apre alle {time}.
De winkel is op {day} gesloten.
{w} {w} {w} {title} {w} {w}.
{W} {w} {w} {n3} {w} {w}
{W}: {ref}
{W}: {title}
{W}: {n8}
{w} {code} {w} {w}
{W} {w} {w} {code}, {w} {ref}.
{W} {W} {w} {w} {W} {w}.
{W} {w} {w} {place} {w} {w}.
{W} {w} {w} {w} {w} {w}, {w} {w} {w}.
{W} {w} {n6} {w}, {W} {w} {n10}.
{W} {w} {w}: {version}
{w} {w} {team} {w} {w} {team}
{W} {w} {product} {w} {w}.
{W} {w} {given} {w} {w}.
{w} {ssnlike} {w} {w}
{W} {phonelike}, {w} {w}
{W} no. {n8} {w} {w}
{W} {n2} {W} {W} {w} {w}
{w} {n1} {W} {W}, {n3} {W}
{W} number {ssnlike} {w} {w}.
{W} {w} number {n8}
The contract number {n8} is void.
Account {n10} was charged twice.
Loyalty card {n12}, {n3} points
Booking code {code}, two adults
Licence plate {code} blocked the gate.
The personal best was {time}, the national record {time}.
Social club, {n2} members, security guard at the door
Passport photos cost {amount}.
National park, entrance {n1}
Our identity is our brand, says the {role}.
Insurance claim {ref} for {amount}
Tax of {amount} was paid in {month}.
Mail order catalogue, phone orders until {time}
Street food at {n2} stalls from {time}
The driver's seat {n2} is torn.
Person of the year, number {n1} in the charts
Frau und Herr Doktor sind verreist.
Madame est servie, Monsieur est absent.
Captain and crew left {place} at {time}.
The captain of the {cap} lost {n1} boats.
Reported by {team} at {time}
Approved by {team} on {date}
Assigned to {team}; watcher {team}
created by {product}, closed by {team}
Owner: {team}
Approved: yes, Reported: no, Closed: {date}
Name: {product} Date: {date} Place: {place}
Guest: {title}, room {n3}
{title} and {title}
{title}, {title}, {title}
{n1}. {title}
{n1}. {title}, {n2} points
* {title}, {n4}
- {product}
{title} / {title}
{title} ({place})
Best, {team}
Sincerely, {team}, {place}
Cordialement, {team}
Gruß, {team}
The {n2} tonne lorry stopped at {n2} degrees.
In {year} the {n2} storey tower was built.
There are {n2} way signs and {n1} court sides.
Take exit {n2} and drive {n1} miles north.
{n3} metres past the square
{n2} High Chairs, {n1} Main Valves, {n2} River Stones
The {n1} place table seats {n2} guests.
{place} {n3}, {place} {n2}, draw
{month} {n2}, {year}
{product} {n2}, {product} {n1}
The {title} of {place} opened in {year}.
They use {product} and {product} at {place} station.
Dr Pepper and Mr Bean are on the shelf.
Long Live the King, shouted the crowd.
Good Morning, Good Night, Happy Birthday
New Year, Black Friday, Easter Monday
Mark it read, Bill it twice, Frank it once.
Rob the bank in level {n1}, Ray tracing on
Grace Period ends {date}, Faith Hall opens {day}.
Hope Street festival, Joy Division records, Art Gallery
The spare part {ssnlike} costs {amount}.
part number {ssnlike}, part number {phonelike}
Item {ssnlike} and item {ssnlike} are sold out.
stock no {ssnlike}
Screws {ssnlike}, bolts {phonelike}, nuts {n6}
Form {ssnlike} must be signed twice.
Reading {n10}, reading {n10}
Tracking number {n12} is unknown.
tracking {n10}{n3}
Coupon {n12} gives {n2} per cent off.
Batch {n6}-{n3}-{n4} was recalled in {month}.
Batch {phonelike}, barcode {n13}
Sample {code}, sample {code}, blank {n6}
Winning numbers {n2} {n2} {n2} {n4}
Run {n3}-{n2}, run {n3}-{n2}, split {n3}
cost centre {n7}, ledger {n6}
Ping {host} and {host}; only {host} answers.
{host} is up, {host} is down since {time}.
Move the files from {host} to {host} by {day}.
reboot of {host} planned for {date}
{host}:{n4} refused, {host}:{n4} timed out
The backup of {host} stopped at {n2} %.
Device {serial}, firmware {version}
Serial {serial} was swapped for {serial}.
s/n {serial}
{serial} {serial} {serial}
Kit {serial} left stock on {date}.
Purchase {ref} asks for {n2} of {serial}.
Label {serial} is torn, label {serial} is not.
{product} rejects me with {code}.
{product} rejects {code}, {product} accepts it.
I can't sign in to {product} since {day}.
Renewal of {product} costs {amount}.
The {cap} team uses {product}.
From {month} on {product} replaces {product}.
Please grant access to {product} and {product}.
Look at {product} before {time}, then at {host}.
Notes on {product} {version}: nothing new.
Step {n1}. Start {product}. {n1}. Wait.
{n1}. Open {product} {n1}. Close {product} {n1}. Done
At {place}. {n1}. Next point, see {place}. {n1}. End
The plant in {place} has {n2} lines, {place} {n1}.
Stop {n2} {place}, stop {n3} {place}
{cap} {n1}.{n1}.{n4} and {cap} {n2}.{n1}
{cap} {n3}, {cap} {n2}, {cap} {n1}
Gate {n2}, Gate {n3}, Tower {n2}
Locker {n3} at {place}, shelf {n2} in {place}
{n2} Bay Rack at {place}, {n1} Button Pad
Rack {n2}, unit {n1}, cable {n3}-{n2}
Desk {n3} is free, desk {n2} is taken.
queue {word}-{word} holds {n4} jobs
group {word}_{word}_{n3} is empty
policy {word}.{word} denies {word}
job {cap}_{n3} failed, job {cap}_{n2} passed
ERR_{capital}_{n4} after {n2} s
Event {n4}, source {cap}
"{cap} error {n4}" pops up, then "{product} closed".
share \{host}\{word} is full
\{host}\{word}\{n4} cannot be opened
{word}@{host} runs the script {word}.sh
Mail queue of {host}: {n3}
ticket {ref} duplicates ticket {ref}
Change {ref} touches {host} and {product}.
Was {ref} closed by {team}?
We told {team} about {product} on {date}.
Firmware {phonelike}
firmware {version} and firmware {phonelike} differ
Tracking ID {n13} came back empty.
tracking id: {n12}
gate {n3} to gate {n3}
Bags left at Gate {n2}, bench {n3}
batch {phonelike}, batch {n6}
Sign in to {product} fails.
sign-in to {product} failed with {code}
The {n1} por ciento rule, {n2} Prozent, {n2} pour cent
Serial number {serial} is not readable.
The {thing} with serial number {serial} is broken.
The scanner with s/n {serial} beeps.
a torn page, a blank page, a short day and a long night
the back page of the book is missing, the front page is torn
turn the page, close the window, fill in the blank field
a grey stone, a green field, a cold river and a long hill
an empty hall ends in a dark wood
{product}, {product} and {product} are new.
the trial of {product} ends in {month}
My {product} account is locked.
Sign up for {product} by {date}.
The upgrade of {product} starts on {day}.
Nobody at {place} uses {product}.
Ask for {product} at the {thing}.
Demand for {product} is low.
A number for {serial} is missing.
An order for {serial} and {serial} came in.
article {phonelike}, article {ssnlike}
Lot no. {phonelike}
lot {phonelike} and lot {ssnlike}
gasket {ssnlike}, washer {ssnlike}
loyalty number {n12}
parcel {n12} was lost, parcel {n10} was found
shipment no. {n12}
reference number {n8}, case number {n6}
member number {n6}, membership until {year}
The card number ends in {n4}.
L'{w} est {w} depuis {day}.
d'{w} {w}, l'{w} {w}
"""

# Plain words used to fill slots.
ROLES = "baker;bus driver;treasurer;caretaker;midwife;violin teacher;judge;farmer;electrician;florist;goalkeeper;pilot;editor;chairwoman;cook;gardener;postman;vet;pharmacist;surveyor;tax adviser;head nurse;deputy mayor;office manager;accountant".split(";")
TEAMS = "the parish council;The Garden Club;Town Hall;Lost Property;Night Shift;front desk;Customer Care;Human Resources;the tenants' board;Ticket Office;the lending library;Tax Office;Book Club;Legal Affairs;the rowing crew;Quality Control;Cleaning Staff;the events committee;Ground Floor Team;Water Works;Sales Support;IT Operations;Group Accounting;Field Service".split(";")
THINGS = "lawn mower;kettle;bicycle;garden gate;piano;freezer;dishwasher;wheelbarrow;tent;oven;sewing machine;ladder;stroller;fence;rowing boat;heater;telescope;suitcase;router;printer;washing machine;drum kit;camera;vending machine".split(";")
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MONTHS = "January February March April May June July August September October November December".split()
STREETS = "Street Road Avenue Lane Close Court Crescent Way Row Terrace Drive Place Square Gardens Hill Walk Boulevard St Rd Ave Ln Blvd Dr Ct".split()
STREET_NAMES = "Mill Church Station Park High King Queen Victoria Oak Elm Maple Cedar Chestnut Willow Spring Lake River Bridge Castle Chapel Market School Garden Orchard Meadow Harbour Forest Hill Prospect Washington Lincoln Franklin Jefferson Albert Saint-James Main Cherry Walnut Ridge Sunset Pleasant".split()
GIVEN = (
    "Anna Maria Peter Thomas Laura Elena Ivan Olga Hassan Fatima Ahmed Yusuf Wei Mei Jun Hiroshi Yuki Kenji Priya Arjun Rahul Anjali Deepak Sunita Carlos Lucia Diego Sofia Pablo Carmen Luca Giulia Marco Chiara "
    "Pierre Camille Antoine Margaux Lars Ingrid Sven Astrid Bjorn Freya Aoife Niamh Sean Siobhan Owen Bronwyn Hamish Fiona Kwame Ama Chidi Ngozi Thabo Zanele Leila Omar Zeynep Emre Tomasz Agnieszka Jakub Zofia "
    "Petra Milan Katarina Goran Janos Eszter Dimitri Eleni James Emily Oliver Charlotte Henry Amelia George Harriet Walter Edith Nathan Rebecca Simon Judith Martin Helen Stephen Joanna"
).split()
FAMILY = (
    "Smith Taylor Walker Hughes Morgan Fletcher Barlow Whitaker Pemberton Ashworth Kowalski Nowak Novak Horvat Petrov Ivanova Sokolov Popescu Nagy Szabo Papadopoulos Demir Yilmaz Haddad Mansour Rahman Khan Patel Sharma "
    "Gupta Iyer Nakamura Tanaka Suzuki Chen Wang Nguyen Tran Kim Park Okafor Mensah Dlamini Abebe Garcia Fernandez Ortega Castillo Silva Costa Moreira Rossi Bianchi Ferrari Moreau Lefevre Girard Dubois Muller Schmidt "
    "Fischer Weber Hoffmann Lindqvist Andersson Johansen Nielsen Virtanen Korhonen Janssen Bakker Visser Murphy Gallagher Macleod Campbell Stewart Griffiths Llewellyn Beckett Hawthorne Langley Thorne Winslow"
).split()
PLAIN_GIVEN = "Grace Faith Chase Mark Juan Joy Rose Will Bill Frank Hope Art May June Dawn Iris Ray Drew Rob Pat Jack Lily Miles Guy".split()
PLAIN_FAMILY = "Baker Brown Young Wood Stone King Fields Rivers Banks Cook Page Reed Cross Long Marsh Bush Price Bell West Snow Frost Green Short Day Hall Hill".split()
TOWNS = "Leeds Boston Hamburg Lyon Madrid Austin Denver Turin Oslo Prague Geneva Bristol Dublin Valencia Zurich Portland".split()
PREFIXES = "O' Mc Mac de van von di al- el- da".split()
ONSETS = "b br ch d dr f fl g gl gr h j k kh kr l m n p pl pr r s sh sk sl st t th tr v vl w y z".split()
VOWELS = "a e i o u ai ea ia ou ee oo ö ü é".split()
GIVEN_ENDS = "ra la na eth ard ira ine wen man vik essa ola ette us io an is mo el lyn ric bert".split()
FAMILY_ENDS = "son man sen berg quist moor dorn feather ova sund ak oux ello ani ury etis ander ez stein field wood ley ton well ski wicz idis yan".split()
STREET_STEMS = "gate wood field dale bourne brook mere bark hill ham stone".split()
NOUNS = "Apple Archive Autumn Backup Banner Barrel Basket Billing Border Bottle Branch Budget Butter Button Camera Cancel Candle Canvas Carbon Change Charge Circle Client Cloud Coffee Colour Column Comment Common Control Copper Corner Cotton Counter Cover Create Credit Crystal Data Delete Delivery Design Device Digital Double Export Factory Feature File Filter Finance Folder Forward Free Future General Glass Global Guest Health Import Index Insert Island Kitchen Ladder Ledger Letter Library Light Linear Local Manual Master Media Member Memory Message Metal Mobile Monthly Motor Network Number Office Online Open Order Owner Paper Parent Payment Pencil Pilot Plan Planet Plastic Platform Portal Power Print Public Quick Radio Record Remote Report Request Reset Review Return Rocket Sales Sample Save Screen Search Secure Select Server Service Session Settings Shared Signal Silver Simple Smart Solar Source Standard Start Status Stock Storage Studio Submit Summer Support Switch System Table Target Test Thunder Ticket Timber Tower Track Training Travel Update User Valley Vendor Video View Virtual Visitor Volume Weekly Window Winter".split()


class Values:
    """Invented values for the slots. given, family: the names of a name list, used for a third of all names."""

    def __init__(self, seed: int, given: list[str], family: list[str], words: list[str] | None = None) -> None:
        self.rng, self.known = random.Random(seed), {"given": given, "family": family}
        self.words = words or [w.lower() for w in NOUNS]
        self.pick = self.rng.choice
        self.makers = self._makers()

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def hex(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789ABCDEF", k=n))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))

    def form(self, pattern: str) -> str:
        """9 stands for a digit, 8 for one from 1 to 9, A for a letter; all else for itself."""
        return "".join(self.digits(1) if c == "9" else str(self.rng.randrange(1, 10)) if c == "8" else self.letters(1) if c == "A" else c for c in pattern)

    def stem(self, most: int = 2) -> str:
        return "".join(self.pick(ONSETS) + self.pick(VOWELS) for _ in range(self.rng.randrange(1, most + 1)))

    def one_name(self, kind: str) -> str:
        first = kind == "given"
        k = self.rng.random()
        if k < 0.1:
            return self.pick(PLAIN_GIVEN if first else PLAIN_FAMILY)
        if k < 0.4 and self.known[kind]:
            return self.pick(self.known[kind])
        if k < 0.7:
            return self.pick(GIVEN if first else FAMILY)
        return (self.stem() + self.pick(GIVEN_ENDS if first else FAMILY_ENDS)).capitalize()

    def name(self) -> str:
        g, f, k = self.one_name("given"), self.one_name("family"), self.rng.random()
        if k < 0.06:
            g = f"{g}-{self.one_name('given')}"
        elif k < 0.14:
            g = f"{g} {self.letters(1)}{self.pick(['.', '.', ''])}"
        elif k < 0.24:
            g = f"{g[0]}."
        elif k < 0.27:
            g = f"{g[0]}. {self.letters(1)}."
        elif k < 0.31:
            f = f"{f}-{self.one_name('family')}"
        elif k < 0.37:
            p = self.pick(PREFIXES)
            f = p + ("" if p[-1] in "'-c" else " ") + f
        elif k < 0.41:
            g = f"{g} {self.one_name('given')}"
        out = f"{f}, {g}" if self.chance(0.15) and not 0.14 <= k < 0.27 else f"{g} {f}"
        return out.upper() if self.chance(0.1) else out.lower() if self.chance(0.06) else out

    def email(self) -> str:
        g, f = (self.one_name(k).lower().replace(" ", "") for k in ("given", "family"))
        word = self.pick(NOUNS).lower()
        local = self.pick([f"{g}.{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}_{f}", f"{g}-{f}", f"{f}{self.digits(2)}", f"{g}{self.digits(2)}", f"{g}.{f}", f"{f}.{g}", word, f"{word}.{f}", f"{g}.{f}{self.digits(1)}"])
        local += "+" + self.pick(NOUNS).lower() if self.chance(0.12) else ""
        host = self.pick([self.stem() + self.pick(["", "x", "s", "m"]), word, f"{word}-{self.stem(1)}", self.stem(3)])
        domain = ([self.pick(["mail", "post", "lists", "eu"])] if self.chance(0.25) else []) + [host] + self.pick([["com"], ["org"], ["net"], ["example"], ["test"], ["invalid"], ["de"], ["fr"], ["co", "uk"], ["io"], ["edu"]])
        at, dot = self.pick([("@", ".")] * 9 + [(" @ ", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", "."), ("[at]", "[dot]"), ("(at)", "."), (" AT ", " DOT ")])
        out = local + at + dot.join(domain)
        return out.upper() if self.chance(0.06) else out

    def phone(self) -> str:
        if self.chance(0.15):
            return self.form("8998999999")
        return self.form(self.pick([
            "899-899-9999", "(899) 899-9999", "899.899.9999", "+1 899 899 9999", "+1-899-899-9999", "+1 (899) 899-9999", "899 899 9999", "1-899-899-9999",
            "07899 999999", "07899 999 999", "+44 7899 999999", "+44 (0)7899 999999", "0044 7899 999 999", "020 8999 9999", "(0899) 999 9999", "+44 20 8999 9999", "01899 999999", "+44 (0)899 999 9999",
            "+49 89 9999999", "089 9999999", "0899/999999", "+49 (0)899 999999", "+33 8 99 99 99 99", "08 99 99 99 99", "+34 899 999 999", "899 99 99 99", "+39 89 9999 9999", "+46 89 999 99 99", "+31 8 99999999", "+81 8-9999-9999", "+91 89999 99999", "+61 899 999 999", "(08) 9999 9999",
        ]))

    def id_number(self) -> str:
        year, month, day = self.digits(2), f"{self.rng.randrange(1, 13):02d}", f"{self.rng.randrange(1, 29):02d}"
        born = [year + month + day + self.pick("-+/") + self.digits(4), "19" + year + month + day + "-" + self.digits(4), day + month + year + self.pick(["-", ""]) + self.digits(4), year + month + day + self.digits(5)]
        spaced = self.pick(["-", " ", ""])
        forms = ["999{}99{}9999", "999{}99{}9999", "999{}99{}9999", "AA{}99{}99{}99{}A", "AA{}99{}99{}99{}A", "AA{}99{}99{}99{}A", "A99999999", "AA9999999", "A9999999", "999999999", "99999999A", "A9999999A", "9999 9999 9999", "99 999 999 999", "99A9999999"]
        return self.pick([*born, *(self.form(p.replace("{}", spaced)) for p in forms)])

    def address(self) -> str:
        no = str(self.rng.randrange(1, self.pick([30, 300, 2000]))) + (self.pick("abcABC") if self.chance(0.12) else "")
        road = self.pick(STREET_NAMES) if self.chance(0.4) else self.one_name("family") if self.chance(0.3) else (self.stem() + self.pick(STREET_STEMS)).capitalize()
        k = self.rng.random()
        if k < 0.22:
            return f"{road}{self.pick(['weg', 'straße', 'strasse', 'str.', 'gasse', 'platz', 'allee', 'straat', 'laan', 'gatan', 'vägen'])} {no}"
        comma = "," if self.chance(0.15) else ""
        if k < 0.34:
            return f"{no}{comma} {self.pick(['avenue du', 'rue de', 'rue du', 'rue de la', 'boulevard', 'avenue de', 'place de', 'chemin du', 'rue'])} {road}"
        if k < 0.44:
            return f"{self.pick(['calle', 'Calle de', 'Via', 'Avenida', 'Calle', 'via', 'Rua', 'Plaza de'])} {road}{comma} {no}" if self.chance(0.6) else f"{no}{comma} {self.pick(['calle de', 'via', 'calle', 'avenida'])} {road}"
        if k < 0.48:
            road = f"{self.rng.randrange(2, 99)}th"
        ahead = self.pick(["Old ", "W. ", "N. ", "New ", "East ", "Upper ", "South ", "Great ", "E ", "St. "]) if self.chance(0.16) else ""
        return f"{no}{comma} {ahead}{road} {self.pick(STREETS)}"

    def cap(self) -> str:
        return (self.stem() + self.pick(["aa", "os", "yen", "ia", "en", "x", "ea", "iora", "da", "um", "ix"])).capitalize()

    def place(self) -> str:
        if self.chance(0.33):
            return self.pick(TOWNS)
        return self.cap()[:-1] + self.pick(["ford", "holm", "by", "wick", "stead", "burgh", "haven", "mere", "ville", "ton", "stadt"])

    def number(self, n: int) -> str:
        return str(self.rng.randrange(1, 10)) + self.digits(n - 1)

    def word(self) -> str:
        return self.cap().lower() if self.chance(0.5) else self.pick(NOUNS).lower()

    def title(self) -> str:
        return " ".join(self.pick(NOUNS) for _ in range(self.pick([1, 2, 2, 2, 3])))

    def date8(self) -> str:
        return f"20{self.rng.randrange(10, 31)}-{self.rng.randrange(1, 13):02d}-{self.rng.randrange(1, 29):02d}"

    def date(self) -> str:
        k, d, m = self.rng.randrange(6), self.rng.randrange(1, 29), self.rng.randrange(1, 13)
        if k < 2:
            return self.date8() if k else f"{d} {self.pick(MONTHS)}"
        if k < 4:
            return f"{d}.{m}.20{self.digits(2)}" if k == 2 else f"{self.pick(DAYS)} {d} {self.pick(MONTHS)}"
        return f"{m}/{d}/{self.digits(2)}" if k == 4 else f"{d:02d}/{m:02d}/19{self.digits(2)}"

    def product(self) -> str:
        if self.chance(0.3):
            return self.title()
        return self.cap() + (" " + self.pick(NOUNS) if self.chance(0.67) else "")

    def host(self) -> str:
        middle = self.pick([self.place, self.cap, self.word])().lower()
        return f"{self.pick(['app', 'db', 'fs', 'web', 'vm', 'gw', self.stem(1)])}{self.pick(['-', '-', ''])}{middle}{self.pick(['-', '', '-0'])}{self.number(self.rng.randrange(1, 4))}"

    def other(self, slot: str) -> str:
        """A value of a slot that holds nothing to be found; n5 is a number of five digits."""
        make = self.makers.get(slot)
        return make() if make else self.number(int(slot[1:]))

    def _makers(self) -> dict:
        pick, form = self.pick, self.form
        lists = {"day": DAYS, "month": MONTHS, "role": ROLES, "thing": THINGS, "w": self.words}
        forms = {
            "ref": ["AAA999999", "A-99999", "#999999", "AA-9999-99999", "AAA-99", "9999/999", "AAAA9999999", "no. 99999"],
            "code": ["AA-9999", "AAA99999", "A99", "AA99A", "0x899A99A9", "A-999-A", "AAAA-999", "99A-9999", "AA999999"],
            "version": ["8.9.9", "8.99", "89.9.999", "8.9.99-rc9", "8.9.9.9", "2029.9"],
            "postcode": ["89999", "8999", "A89 9AA", "AA8 9AA", "89999-9999", "8999 AA"],
            "isbn": ["978-8-99-999999-9"],
            "ssnlike": ["899-99-9999", "899-99-9999", "89-99-99", "899 99 9999", "AA 99 99 99 A"],
            "phonelike": ["899-899-9999", "899-999", "8999 999 999", "89999 999999", "899.899.9999"],
        }
        made = {k: (lambda v=v: pick(v)) for k, v in lists.items()} | {k: (lambda v=v: form(pick(v))) for k, v in forms.items()}
        return made | {
            "time": lambda: f"{self.rng.randrange(0, 24):02d}:{self.rng.randrange(0, 60):02d}" if self.chance(0.7) else f"{self.rng.randrange(1, 12)} {pick(['am', 'pm'])}",
            "place": self.place,
            "product": self.product,
            "title": self.title,
            "cap": self.cap,
            "capital": lambda: self.cap().upper(),
            "word": self.word,
            "date8": self.date8,
            "date": self.date,
            "year": lambda: f"{pick(['19', '20'])}{self.digits(2)}",
            "team": lambda: pick(TEAMS) if self.chance(0.5) else f"{pick(NOUNS)} {pick(['Team', 'Desk', 'Group', 'Crew', 'Office', 'Room']) if self.chance(0.1) else pick(NOUNS)}",
            "given": lambda: self.one_name("given"),
            "family": lambda: self.one_name("family"),
            "amount": lambda: pick(["$", "€", "£", "EUR ", "USD "]) + form(pick(["89", "899.99", "8,999.00", "89.50"])),
            "url": lambda: f"https://{self.word()}.{pick(['org', 'com', 'net', 'example'])}/{self.word()}/{self.number(3)}",
            "ip": lambda: ".".join(str(self.rng.randrange(1, 255)) for _ in range(4)),
            "mac": lambda: ":".join(self.hex(2) for _ in range(6)),
            "hex8": lambda: self.hex(8).lower(),
            "host": self.host,
            "serial": lambda: form("".join(pick(["A", "AA", "9", "99", "9999"]) for _ in range(self.rng.randrange(3, 6)))),
            "W": lambda: pick(self.words).capitalize(),
        }


PLAIN_SLOTS = "w w w w w w W W product product host serial ref code n1 n2 n3 n4 n6 n10 version title title place place date time team thing role ip word cap ssnlike amount given".split()
FOUND_SLOTS = "name name name address address email phone".split()


def random_lines(rng: random.Random, n: int) -> list[str]:
    """Lines of slots in any order; a third of them hold something to be found, between small words or signs."""
    out = []
    for _ in range(n):
        parts = ["{" + rng.choice(PLAIN_SLOTS) + "}" + rng.choice(["", "", "", "", ",", ".", ":", ";", ")", "?"]) for _ in range(rng.randrange(3, 12))]
        if rng.random() < 0.35:
            i = rng.randrange(len(parts) + 1)
            parts[i:i] = [rng.choice(["{w}", "{w}", "{w}:", "{W}:", "-", "|"]), "{" + rng.choice(FOUND_SLOTS) + "}" + rng.choice(["", ",", ".", ";", "|"]), "{w}"]
        out.append(" ".join(parts))
    return out


def table_lines(block: str) -> list[str]:
    """The entries of a table: lines that a signature or an address block continues belong together."""
    out: list[str] = []
    for line in block.strip().split("\n"):
        if out and out[-1].split("\n")[0] in ("Deliver to:", "Sender:", "Yours sincerely,", "Yours faithfully", "Cheers,", "name: {name}") and line in ("{name}", "{address}", "{postcode} {place}", "{phone}", "e-mail: {email}", "tel: {phone}"):
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def fixed_parts(block: str, least: int) -> list[str]:
    """The literal pieces of at least so many characters between the slots of a table's lines."""
    import re

    return [p.strip() for line in block.strip().split("\n") for p in re.split(r"\{\w+\}", line) if len(p.strip()) >= least]


def labelled_texts(seed: int, per_line: int, given: list[str], family: list[str], words: list[str] | None = None, lines: list[str] | None = None, mixed: float = 0.0) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, stop, kind)]): every line of both tables (or the given ones) filled per_line times, up to three lines to a
    text. words: plain words, by which a part of the fixed words is replaced, so that the field doesn't learn the lines by heart. mixed: so many random_lines
    for each filled line."""
    rng = np.random.default_rng(seed)
    values = Values(seed, given, family, words)
    lines = lines if lines is not None else table_lines(LABELLED) + table_lines(RESEMBLING)
    made = []
    for line in lines * per_line + random_lines(values.rng, int(mixed * len(lines) * per_line)):
        text, spans, rest = "", [], line
        noise = values.pick([0.0, 0.1, 0.35]) if words else 0.0

        def literal(s: str, noise: float = noise) -> str:
            if not noise:
                return s
            return "".join(w if not (w.isalpha() and len(w) > 3 and rng.random() < noise) else values.other("W" if w[0].isupper() else "w") for w in _pieces(s))

        while "{" in rest:
            before, _, rest = rest.partition("{")
            slot, _, rest = rest.partition("}")
            text += literal(before)
            if slot in KINDS:
                value = getattr(values, slot)()
                spans.append((len(text), len(text) + len(value), slot))
                if slot == "address" and value.split()[-1] in ("St", "Rd", "Ave", "Ln", "Blvd", "Dr", "Ct") and rng.random() < 0.5:
                    value += "."
            else:
                value = values.other(slot)
            text += value
        text += literal(rest)
        k = rng.random()
        if k < 0.3:
            text = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        elif k < 0.37:
            text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        if not spans and rng.random() < 0.15:  # some senders drop all punctuation
            text = " ".join("".join(c if c.isalnum() else " " for c in text).split())
        if rng.random() < 0.12:
            text = "".join("\n" if c == " " and rng.random() < 0.15 else c for c in text)
        made.append((text, spans))
    out = []
    order = rng.permutation(len(made))
    i = 0
    while i < len(order):
        text, spans = "", []
        for j in order[i : i + int(rng.integers(1, 4))]:
            t, s = made[j]
            lead = values.pick(["", "> ", "- ", "* ", "<p>", "PS: ", "fwd: ", "note: "]) if rng.random() < 0.25 else ""
            text += (values.pick([" ", "\n", "\n\n", " "]) if text else "") + lead
            spans += [(a + len(text), b + len(text), k) for a, b, k in s]
            text += t
            i += 1
        out.append((text, spans))
    return out


def _pieces(s: str) -> list[str]:
    import re

    return re.findall(r"[^\W\d_]+|[\W\d_]+", s)
