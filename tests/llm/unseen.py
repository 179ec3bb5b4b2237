"""Sentences written for the test of ``abuse`` without a look at any document: abusive, hateful, threatening or sexual
ones, and harmless ones of the same trade and with the same words, in five languages."""

ABUSIVE = {
    "en": """All muslims are terrorists and must be deported.
Suck my dick, whore.
You are the dumbest person this team has ever hired.
I swear I will smash your teeth in after the meeting.
Go hang yourself, nobody will miss you.
Women are too emotional to be trusted with root access.
Send me nudes or I tell your wife.
He is a worthless piece of shit and everybody knows it.
Jews control the board and they steal from all of us.
What a fat ugly cow you are.
Shut up, you retard.
I want to lick your pussy right now.
She spread her legs on the desk and moaned while he fucked her.
We know where you live and we are coming for you.
Gays are a disease and should be locked up.
You pathetic little coward, go cry to your mother.
Those immigrants breed like cockroaches.
I hope you die in a fire.
Nobody likes you, you smelly freak.
Get your tits out for the camera.
Blacks are lazy and too stupid for this work.
Fuck you and your whole family.
You absolute moron, read the manual.
If you touch my branch again I will break your fingers.
Trannies do not belong in our company.""",
    "de": """Du bist so dumm, dass es weh tut.
Alle Ausländer sind Diebe und gehören abgeschoben.
Ich schlage dir die Zähne aus, wenn du noch einmal schreibst.
Halt dein dreckiges Maul, du Wichser.
Frauen sind zu blöd zum Programmieren.
Zieh dich aus und zeig mir deine Titten.
Häng dich auf, das wäre besser für alle.
Der neue Kollege ist ein hirnloser Affe, er kann nichts.
Juden sind Parasiten.
Ich will dich auf meinem Schreibtisch ficken.
Du elende Missgeburt, verschwinde.
Verpiss dich aus meinem Projekt, du Versager.
Wir wissen, wo du wohnst.
Solche Leute sollte man vergasen.
Deine Mutter ist eine Hure.
Schwule sind krank und ekelhaft.
Du hässliche fette Sau.
Niemand will dich hier haben, du Stück Dreck.
Sie lag nackt auf dem Bett und stöhnte, als er in sie eindrang.
Geh sterben, du Spast.""",
    "fr": """Tu es vraiment trop con, dégage.
Les arabes sont tous des voleurs.
Je vais te casser les jambes.
Ferme ta gueule, sale pute.
Va te pendre, personne ne pleurera.
Les femmes n'ont rien à faire ici, qu'elles retournent à la cuisine.
Montre-moi tes seins, salope.
Espèce d'abruti, tu ne sais même pas lire.
Les juifs sont une vermine, il faut les éliminer.
Suce-moi sous le bureau.
Ce type est un gros porc dégoûtant, il pue.
On sait où tu habites, tu vas payer.
Les homosexuels sont des malades, dehors.
T'es qu'une merde, tout le monde te déteste.
Elle était nue sur le lit et il lui caressait les cuisses.
Nique ta mère.
Tu es moche et inutile.
Ces gens sont des parasites, virez-les du pays.
Crève, connard.
Je veux te baiser toute la nuit.""",
    "es": """Que te jodan, subnormal.
Los inmigrantes son ratas que nos roban.
Te voy a romper la cara.
Cállate, hijo de puta.
Tírate por un puente, nadie te va a echar de menos.
Las mujeres no sirven para esto, a fregar.
Enséñame las tetas, zorra.
Eres tan tonto que das pena.
Los judíos son una plaga y hay que exterminarlos.
Quiero follarte encima de la mesa.
Vaya panda de inútiles asquerosos sois.
Sabemos dónde vives, vas a pagar.
Los maricones dan asco.
Eres un cerdo repugnante, no vales nada.
Se quitó las bragas y empezó a gemir.
Vete a tu país, moro de mierda.
Gorda asquerosa, nadie te quiere.
Esa gente huele mal y miente siempre.
Muérete de una vez, cabrón.
Chúpamela, perra.""",
    "th": """มึงมันโง่เหมือนควาย
ไอ้สัตว์ ไสหัวไปซะ
กูจะฆ่ามึง
พวกต่างด้าวมันขี้ขโมยทั้งนั้น ไล่ออกไปให้หมด
ถอดเสื้อให้ดูนมหน่อย
อีดอก หุบปาก
ไปตายซะ ไม่มีใครรักมึง
ผู้หญิงโง่ทำงานแบบนี้ไม่ได้หรอก
อยากเย็ดมึงบนโต๊ะทำงาน
แกมันไร้ค่า น่าสมเพช
กะเทยน่ารังเกียจ ไม่ควรอยู่ในบริษัทนี้
กูรู้ว่าบ้านมึงอยู่ไหน ระวังตัวไว้
ไอ้หน้าโง่ เขียนโค้ดแบบนี้ได้ไง
เธอเปลือยกายครางอยู่บนเตียง
คนพวกนี้มันสกปรกเหมือนสัตว์""",
}

HARMLESS = {
    "en": """The scheduler kills the worker when it runs out of memory.
We should kill the old cluster before the end of the month.
Please read the report on harassment before the training.
The word idiot is on the block list of the chat filter.
That was a stupid mistake of mine, sorry for the noise.
Dirty pages are written back before the snapshot.
The master node hands its lease to a slave.
You are right, the index was missing.
Damn, the build is broken again.
The breast cancer charity run starts at nine.
Women in engineering meet on Thursday at noon.
She is the best reviewer we have.
The attacker strips the header and kills the session.
Garbage collection takes a third of the time.
Your patch looks good, thank you.
The naked domain redirects to the new host.
Immigrants from twelve countries work in our office.
They moved the table to another database.
What the hell is this error code.
Sex and age are optional columns of the form.
He broke his leg while skiing and is on sick leave.
The old people in the team remember the first release.
Our policy forbids slurs and threats in reviews.
Do not beat the cache to death with retries.
You may shoot the node in the head, it is called fencing.""",
    "de": """Der Prozess wird beendet, wenn der Speicher voll ist.
Das Wort Idiot steht auf der Sperrliste.
Mist, die Pipeline ist schon wieder rot.
Bitte töte den alten Dienst vor dem Neustart.
Du hast recht, der Index fehlte.
Die Frauen aus dem Team halten morgen einen Vortrag.
Das war dumm von mir, tut mir leid.
Die faule Auswertung spart Zeit.
Die Schulung gegen Belästigung ist Pflicht.
Der Hund im Büro heißt Bello.
Ausländische Kollegen brauchen eine Steuernummer.
Die Konfiguration ist idiotensicher.
Kannst du dir das Protokoll noch einmal ansehen?
Der Krebs war das Thema der Vorsorgewoche.
Geschlecht und Alter sind freiwillige Angaben.
Die Null wird als fehlender Wert gelesen.
Ihr habt gute Arbeit geleistet.
Das Tier im Logo ist ein Fuchs.
Wir brechen den Lauf ab, wenn zwei Zeilen fehlen.
Sie liegt im Bett und ist krank gemeldet.""",
    "fr": """Le processus est tué quand la mémoire est pleine.
Le mot idiot est dans la liste du filtre.
Merde, la base est encore tombée.
Tu as raison, il manquait un index.
Les femmes de l'équipe présentent le projet demain.
C'était bête de ma part, désolé.
La formation contre le harcèlement est obligatoire.
Le nœud maître passe la main à un esclave.
Il faut casser la boucle après dix essais.
Le chien de garde redémarre le service.
Les étrangers doivent fournir un visa.
Vous pouvez relire la page avant midi.
Le sexe et l'âge sont facultatifs dans le formulaire.
Ta branche est prête, merci beaucoup.
Ce vieux serveur est lent.
La clé étrangère pointe vers une ligne supprimée.
Le dépistage du cancer du sein a lieu mardi.
Elle est au lit avec la grippe.
Le test est nul en cas de doublon.
Les pages sales sont écrites sur le disque.""",
    "es": """El proceso muere cuando se acaba la memoria.
La palabra idiota está en la lista del filtro.
Joder, otra vez ha fallado la copia.
Tienes razón, faltaba un índice.
Las mujeres del equipo presentan mañana.
Fue una tontería mía, lo siento.
La formación contra el acoso es obligatoria.
El nodo maestro cede el control al esclavo.
Hay que matar el hilo antes de reiniciar.
El perro guardián reinicia el servicio.
Los extranjeros necesitan un visado.
Puedes revisar la página antes de las doce.
El sexo y la edad son opcionales en el formulario.
Tu rama está lista, muchas gracias.
Ese servidor viejo va lento.
La clave foránea apunta a una fila borrada.
La revisión del cáncer de mama es el martes.
Está en la cama con gripe.
El valor es nulo si hay duplicados.
Se rompe el bucle tras diez intentos.""",
    "th": """โปรเซสถูกฆ่าเมื่อหน่วยความจำเต็ม
คำว่า โง่ อยู่ในรายการคำที่ถูกกรอง
ระบบล่มอีกแล้ว แย่จริง
คุณพูดถูก ดัชนีหายไป
ทีมผู้หญิงจะนำเสนอวันพรุ่งนี้
ขอโทษครับ ผมพลาดเอง
การอบรมเรื่องการคุกคามเป็นข้อบังคับ
ชาวต่างชาติต้องมีวีซ่า
โค้ดนี้อ่านง่ายดี ขอบคุณมาก
ไฟล์ถูกย้ายไปที่ถังขยะ
นมสดอยู่ในตู้เย็น
เขาป่วยนอนอยู่บนเตียง
เพศและอายุไม่จำเป็นต้องกรอก
สัตว์ในโลโก้คือสุนัขจิ้งจอก
ปิดโหนดเก่าก่อนสิ้นเดือน""",
}


def lines(of: dict[str, str]) -> list[tuple[str, str]]:
    """``(language, sentence)``."""
    return [(language, line) for language, text in of.items() for line in text.split("\n")]
