"""Texts for precision and recall of the finder, from other templates than the test data: each case is marked {kind:text}.

They were written by the hand that wrote the rules, after the rules and before any text was tried on them. `HARD` was written
next: sentences with little around a case to tell it by."""

TEXTS = [
    "My name is {name:Peter Müller} and I live at {address:12 Abbey Road, London NW8 9AY}.",
    "Dear {name:Thomas}, thank you for your letter.",
    "Please contact {name:Laura Bianchi} at {email:laura.bianchi@azienda.it} or on {phone:+39 02 1234 5678}.",
    "The patient, {name:Helen Ward}, was admitted on 3 May 2021.",
    "Call me on {phone:555 123 4567} after six.",
    "She moved to {address:221B Baker Street, London NW1 6XE} last year.",
    "Abita in {address:Via Roma 12, 00184 Roma} dal 2010.",
    "Mieszka przy {address:ul. Marszałkowska 10, Warszawa} od roku.",
    "His Aadhaar number is {identity:2341 2341 2346}.",
    "请打电话 {phone:13812345678} 联系我。",
    "{name:田中太郎}さんに確認してください。",
    "Best regards,\n{name:Amelia Clarke}\nHead of Finance",
    "Sincerely,\n\n{name:J. R. Whitfield}",
    "I spoke with {name:Mrs. Patel|Patel} yesterday and she agreed.",
    "Dr. {name:Okonkwo} will see you at ten.",
    "Hello {name:Priya}, the invoices are attached.",
    "Hi {name:Marcus}! How are you?",
    "Guten Tag Herr {name:Schneider}, Ihre Bestellung ist da.",
    "Sehr geehrte Frau {name:Dr. Vogel|Vogel}, anbei die Unterlagen.",
    "Ich heiße {name:Jürgen Köhler} und wohne in der {address:Lindenstraße 7, 10969 Berlin}.",
    "Meine Telefonnummer ist {phone:030 12345678}.",
    "Bonjour {name:Camille}, merci pour votre message.",
    "Je m'appelle {name:Élodie Martin}, j'habite {address:14 rue de la République, 69002 Lyon}.",
    "Vous pouvez joindre Mme {name:Lefèvre} au {phone:04 78 12 34 56}.",
    "Estimado {name:Carlos}, le escribo por la factura.",
    "Me llamo {name:Lucía Fernández} y mi DNI es {identity:12345678Z}.",
    "Vive en la {address:Calle Mayor 15, 28013 Madrid} con su hermano.",
    "Olá {name:Beatriz}, tudo bem?",
    "Contact: {name:Sofia Almeida}, {phone:+351 912 345 678}",
    "Name: {name:Robert Chen}\nPhone: {phone:(415) 555-2671}\nSSN: {identity:219-09-9999}",
    "Her social security number is {identity:078-05-1120}.",
    "NI number {identity:AB 12 34 56 C} was used twice.",
    "passport number {identity:X12345678} expires in June",
    "Mail {email:j.o'neil+news@mail.example.co.uk} for details.",
    "reach us: {email:support@firma.de}",
    "Write to {email:anna.k (at) posteo (dot) net} please.",
    "Thanks to {name:Anna Costa} and {name:Luis Vega} for reviewing it.",
    "The report was written by {name:Ingrid Solberg}.",
    "Signed: {name:Tomasz Kowalski}",
    "Ask for {name:Nadia} at the desk.",
    "My colleague {name:Yusuf Demir} will join us.",
    "{name:Maria Rossi} wrote: the file is missing.",
    "{name:Oliver Stone-Hayes} said he would be late.",
    "— {name:Ellen Park}",
    "From: {name:Grace Hopper} <{email:grace@navy.example}>\nTo: {name:Alan Turing} <{email:alan@bletchley.example}>",
    "Customer: {name:Hannah Lindgren}; tel {phone:+46 70 123 45 67}",
    "Ring {name:Mr. Fitzgerald|Fitzgerald} on {phone:020 7946 0958}.",
    "WhatsApp: {phone:+91 98765 43210}",
    "Meu CPF é {identity:123.456.789-09}.",
    "numéro de sécurité sociale : {identity:1 85 05 78 006 084 91}",
    "Meine Steuer-ID lautet {identity:86 095 742 719}.",
    '{{"name": "{name:Wei Zhang}", "email": "{email:wei@zhang.example}"}}',
    "Ship the parcel to {name:Katarzyna Nowak}, {address:5 Oak Avenue, Springfield, IL 62704}.",
    "Our new address: {address:1600 Pennsylvania Avenue}.",
    "He stays at {address:Flat 3, 27 Elm Grove, Bristol BS8 1AB} this month.",
    "Adresse: {address:Hauptstraße 45, 50667 Köln}",
    "Kind regards, {name:Fatima Al-Sayed}",
    "Viele Grüße\n{name:Jonas Weber}",
    "Un cordial saludo,\n{name:Javier Ortega}",
    "cc: {name:Novak, Petra}; {email:petra@novak.example}",
    "It was reported by {name:Samuel Okafor} on 2024-03-01.",
    "Interview with {name:Chloe Dubois}, born 1980-05-03.",
    # texts without any case
    "The Amazon River flows through Brazil and Peru.",
    "Release 2.4.1 of the Python package fixes Issue 4471.",
    "Invoice 20240317-001 totals 1,234,567.89 USD.",
    "The Golden Gate Bridge opened in May 1937.",
    "Version 10.0.19045 build 19041 of Windows is out.",
    "See Chapter 12, Section 3.4 of the Manual.",
    "Order 123-4567890-1234567 has shipped.",
    "The European Commission and the World Bank signed an agreement.",
    "Machine Atlas and machine Orion are down.",
    "ISBN 978-3-16-148410-0, printed in Germany.",
    "At 12:30 on Monday the server Apollo restarted.",
    "Der Zug nach München fährt um 14:05 Uhr ab.",
    "Le musée du Louvre est fermé le mardi.",
    "Use GET /api/v1/users?id=123456789 to fetch it.",
    "The temperature rose from 12 to 25 degrees in 2023.",
    "Lake Victoria, Mount Kenya and the Nile are nearby.",
    "sha256 9f86d081884c7d659a2feaa0c55ad015",
    "Hello everyone, the meeting is at 10.",
    "Dear Sir or Madam, we write about contract 8812-77.",
    "Microsoft and Google compete in the cloud.",
]


HARD = [
    "Yesterday {name:Sarah Jenkins} presented the quarterly results.",
    "We had dinner with {name:Paolo} and his wife {name:Giulia}.",
    "{name:Kwame Mensah} and {name:Ama Boateng} founded the firm in 2011.",
    "According to {name:Dr. Ruth Kaplan|Ruth Kaplan}, the dose was right.",
    "The defendant {name:Michael O'Leary} pleaded guilty.",
    "I think {name:Emma} forgot her keys at the office.",
    "Tell {name:Ravi Shankar} that the car is ready.",
    "{name:Nguyen Van Anh} lives at {address:48 Tran Phu Street, Hanoi}.",
    "Unser Hausmeister {name:Ralf Becker} hat den Schlüssel.",
    "Der Brief ist von {name:Anneliese Baumann} unterschrieben.",
    "C'est {name:Sophie Moreau} qui a signé le contrat.",
    "Habla con {name:Ignacio Torres}, el encargado.",
    "A minha vizinha {name:Teresa Carvalho} telefonou ontem.",
    "Il dottor {name:Marco Ferrari} riceve il lunedì.",
    "Minister {name:Lars Løkke} opened the bridge.",
    "Photo by {name:Inés Salazar}.",
    "Professor {name:Adebayo} teaches chemistry.",
    "Mobile {phone:07911 123456}, office {phone:0161 496 0000}.",
    "Fax: {phone:+49 89 636-48018}",
    "Tél. {phone:01.42.68.53.00}",
    "Text {phone:917-555-0143} when you arrive.",
    "Her number's {phone:+1 (604) 555-0199}.",
    "Tax ID {identity:123-45-6789} on file.",
    "Codice fiscale {identity:RSSMRA85T10A562S}",
    "NIE: {identity:X1234567L}",
    "Personalausweisnummer {identity:L01X00T47}",
    "Deliver to {address:8 Rosewood Crescent, Leeds LS8 2AB}.",
    "Büro: {address:Am Markt 3, 18055 Rostock}",
    "{address:10 Downing Street, London SW1A 2AA}",
    "Casa en {address:Avenida de América 25, 28002 Madrid}",
    "Siège : {address:8 boulevard Haussmann, 75009 Paris}",
    "Send it to {email:first.last@sub.domain.org}, not to {email:old_box@domain.org}.",
    "The Statue of Liberty was a gift from France.",
    "Mount Everest and Mont Blanc attract climbers.",
    "General Motors will recall the Chevrolet Bolt.",
    "On Saturday Real Madrid beat Bayern Munich.",
    "Thanks to Open Source we can ship faster.",
    "Total: 555 123 4567 bytes in 12 files.",
    "Flight LH 454 lands at Terminal 2.",
    "The White House issued Executive Order 14110.",
]


def parse(marked: str) -> tuple[str, set[tuple[str, int]]]:
    """The plain text and its cases (kind, start). {kind:a|b} is a text a whose case is its part b."""
    out, cases, i = "", set(), 0
    while i < len(marked):
        if marked.startswith(("{{", "}}"), i):
            out, i = out + marked[i], i + 2
            continue
        if marked[i] == "{":
            end = marked.index("}", i)
            kind, whole = marked[i + 1 : end].split(":", 1)
            whole, _, part = whole.partition("|")
            cases.add((kind, len(out) + (whole.rindex(part) if part else 0)))
            out, i = out + whole, end + 1
        else:
            out, i = out + marked[i], i + 1
    return out, cases
