"""Words of the voters of ``abuse``: general lexicons of five languages, written from general knowledge of them and from no
corpus.

Fixed values, as they read after folding (lower case, no accents); entries are separated by commas. Latin entries are
found as whole words, with the usual endings of their language (``forms``); Thai ones anywhere."""

from __future__ import annotations

# Nouns that hardly mean anything but an insult.
INSULT = {
    "en": "idiot, moron, imbecile, cretin, asshole, arsehole, bastard, bitch, son of a bitch, scumbag, dickhead, dumbass, jackass, dipshit, douchebag, retard, dimwit, halfwit, nitwit, numbskull, bonehead, wanker, prick, cunt, twat, "
    "whore, slut, lowlife, shithead, fuckwit, fucker, motherfucker, cocksucker, bellend, pillock, tosser, piece of shit, piece of crap, waste of space, waste of oxygen, degenerate, dumb fuck, dunce, simpleton",
    "de": "idiot, vollidiot, trottel, depp, vollpfosten, arschloch, wichser, hurensohn, schlampe, fotze, drecksau, drecksack, dreckskerl, mistkerl, missgeburt, dummkopf, hohlkopf, schwachkopf, blodmann, mistkuh, dreckstuck, nichtsnutz, "
    "abschaum, scheisskerl, stuck scheisse, hure, bastard, kretin, versager, flachzange, saukerl, schweinehund",
    "fr": "idiot, imbecile, cretin, abruti, connard, connasse, salaud, salope, batard, encule, fils de pute, pute, ordure, pourriture, debile, raclure, tocard, trouduc, trou du cul, sous-merde, merdeux, enfoire, crapule, grosse merde, "
    "bouffon, minable, bon a rien, pauvre type, espece de con, sale con, pauvre con, gros con, petit con, conne",
    "es": "idiota, imbecil, gilipollas, cabron, capullo, subnormal, hijo de puta, hijueputa, pendejo, boludo, pelotudo, soplapollas, cretino, tarado, malparido, pedazo de mierda, escoria, mamon, puta, zorra, huevon, lameculos, bastardo, "
    "estupido, mequetrefe, malnacido, desgraciado, comemierda, cabrona",
    "th": "ไอ้โง่, อีโง่, ไอ้ควาย, อีควาย, ไอ้สัตว์, ไอ้สัส, อีสัตว์, สัส, เหี้ย, ไอ้บ้า, อีบ้า, ปัญญาอ่อน, ระยำ, สารเลว, ไอ้ชั่ว, ไอ้เลว, อีเลว, ไร้สมอง, ส้นตีน, หน้าหี, ดอกทอง, อีดอก, กะหรี่, เศษสวะ, สวะ, หน้าตัวเมีย, ชาติหมา, ชาติชั่ว, ไอ้หมา, อีหมา, หน้าโง่, สมองหมา, ไอ้เวร, อีเวร",
}
# Nouns that are insults only when they are said of someone.
NAMES = {
    "en": "pig, swine, rat, dog, worm, leech, parasite, vermin, maggot, cockroach, trash, garbage, filth, scum, clown, coward, creep, jerk, freak, weirdo, loser, fool, liar, snake, cow, donkey, monkey, ape, animal, psycho, crybaby, disgrace, "
    "embarrassment, failure, joke, burden, nobody, zero, dummy, muppet, troll, pervert, savage, monster, cancer, disease, idiots",
    "de": "schwein, sau, ratte, hund, wurm, parasit, ungeziefer, mull, dreck, clown, feigling, spinner, penner, lappen, opfer, affe, esel, kuh, ziege, lugner, nichts, niete, null, schande, witz, belastung, freak, perversling, monster, tier, krebs, pfeife, "
    "lump, schuft, zecke, made",
    "fr": "porc, cochon, rat, chien, chienne, ver, parasite, vermine, dechet, clown, lache, monstre, menteur, ane, singe, truie, vache, larve, cloporte, boulet, honte, rien, nul, nulle, con, bete, taré, zero, poubelle, cafard, pleurnichard, malade, "
    "animal, echec, fardeau",
    "es": "cerdo, cerda, rata, perro, perra, gusano, parasito, basura, payaso, cobarde, bicho, monstruo, mentiroso, burro, mono, vaca, verguenza, nada, nadie, inutil, tonto, bobo, bestia, animal, cucaracha, fracaso, fracasado, carga, enfermo, loco, lastre, "
    "alimana, sanguijuela",
    "th": "ควาย, โง่, หมา, ขยะ, เลว, ชั่ว, กระจอก, ไร้ค่า, สันดาน, ขี้ขลาด, ขี้แพ้, บ้า, แรด, ไร้ประโยชน์, ตัวถ่วง, น่าสมเพช, ทุเรศ, เดรัจฉาน, ปลิง, กาก, ห่วย",
}
# Adjectives that put someone down.
DEMEAN = {
    "en": "stupid, dumb, dumber, dumbest, worthless, pathetic, useless, brainless, braindead, brain-dead, disgusting, filthy, ugly, fat, lazy, incompetent, miserable, clueless, spineless, gutless, rotten, idiotic, moronic, ignorant, dirty, nasty, repulsive, "
    "revolting, vile, stinking, lousy, wretched, hopeless, mindless, talentless, retarded, ridiculous, slimy, smelly, sick, creepy, fucking, inferior",
    "de": "dumm, dummer, blod, bescheuert, hirnlos, nutzlos, wertlos, erbarmlich, widerlich, ekelhaft, hasslich, fett, faul, dreckig, unfahig, lacherlich, jammerlich, armselig, gestort, verblodet, hohl, behindert, unterbelichtet, minderwertig, stinkend, "
    "elend, schmierig, verlogen, krank, verdammt, verfickt, mies",
    "fr": "stupide, bete, debile, nul, inutile, minable, pitoyable, degoutant, moche, laid, gros, grosse, sale, pauvre, incapable, incompetent, ignoble, repugnant, miserable, crade, ridicule, attarde, feignant, lache, putain de, espece de, vieux, vieille, "
    "lamentable, pathetique, con, malade, affreux",
    "es": "estupido, tonto, inutil, patetico, asqueroso, feo, gordo, sucio, miserable, incompetente, ridiculo, retrasado, repugnante, despreciable, maldito, ignorante, apestoso, lamentable, descerebrado, puto, pedazo de, mierda de, vago, penoso, inmundo, "
    "enfermo, cobarde, torpe",
    "th": "โง่, สกปรก, อัปลักษณ์, น่าเกลียด, ขี้เกียจ, ไร้ค่า, ปัญญานิ่ม, น่าสมเพช, ทุเรศ, น่ารังเกียจ, น่าขยะแขยง, ไร้น้ำยา, อ้วน, เหม็น, ไร้ความสามารถ",
}
SLUR = {
    "en": "nigger, nigga, faggot, fag, tranny, kike, spic, chink, gook, wetback, raghead, towelhead, paki, dyke, cripple, gyppo, shemale, redneck, untermensch, subhuman, mudslime, slanteye",
    "de": "neger, nigger, kanake, kanacke, schwuchtel, zigeuner, spast, spasti, mongo, kruppel, judensau, schlitzauge, asylantenpack, transe, kampflesbe, untermensch, kameltreiber, knoblauchfresser",
    "fr": "negre, negro, bougnoule, bicot, pede, tapette, gouine, youpin, mongol, bamboula, tantouze, chinetoque, tarlouze, sous-homme, feuj, romano",
    "es": "maricon, marica, sudaca, negrata, panchito, bollera, travelo, mongolo, machupichu, infrahumano, moro de mierda, negro de mierda, sidoso, indio de mierda",
    "th": "อีตุ๊ด, ไอ้ตุ๊ด, ไอ้แขก, ไอ้มืด, ไอ้ลาว, ไอ้เจ๊ก, อีกะเทย, ไอ้พม่า, เจ๊ก, ไอ้ง่อย",
}
PROFANITY = {
    "en": "fuck, fucked, fucking, shit, shitty, bullshit, damn, damned, goddamn, crap, crappy, bloody, hell, arse, ass",
    "de": "scheisse, scheiss, verdammt, verflucht, kacke, mist, fick, ficken, arsch, verfickt",
    "fr": "merde, putain, bordel, foutre, chier, cul, chiant, emmerde, emmerder",
    "es": "mierda, joder, cono, hostia, carajo, cojones, culo, puto, chingar, chingada",
    "th": "เชี่ย, แม่ง, ห่า, เวร, ตีน, กวนตีน, เสือก",
}
# Ways of silencing someone or sending them away.
SILENCE = {
    "en": "shut up, shut your mouth, shut the fuck up, shut your face, shut your trap, fuck you, fuck off, screw you, piss off, get lost, go to hell, go fuck yourself, drop dead, get out of my sight, nobody likes you, nobody wants you, nobody asked you, no one likes you, "
    "no one wants you, you make me sick, you disgust me, rot in hell, burn in hell, i hate you, kiss my ass, eat shit, go back to where you came from, go back where you came from, crawl back, up yours, bite me, sod off, bugger off, we all hate you, everyone hates you",
    "de": "halt die klappe, halt deine klappe, halt endlich die klappe, halt die fresse, halt deine fresse, halt dein maul, halt das maul, fick dich, verpiss dich, leck mich, fahr zur holle, zieh leine, hau ab, scher dich, niemand mag dich, niemand will dich, keiner mag dich, "
    "keiner will dich, du kotzt mich an, du ekelst mich an, ich hasse dich, du kannst mich mal, geh zur holle, halt den mund, halt den rand, mach dich vom acker, schnauze, geh mir aus den augen",
    "fr": "ta gueule, vos gueules, ferme la, ferme-la, la ferme, va te faire foutre, va te faire enculer, va te faire voir, casse toi, casse-toi, degage, degagez, nique ta mere, nique ta race, va chier, je te deteste, tu me degoutes, va au diable, personne ne t'aime, "
    "personne ne veut de toi, tu me fais vomir, fous le camp, barre toi, barre-toi, je te hais, tu pues, je t'emmerde, retourne d'ou tu viens, rentre chez toi, tais-toi",
    "es": "callate, cierra la boca, cierra el pico, vete a la mierda, que te jodan, que te den, vete al carajo, vete al infierno, jodete, chupamela, me das asco, dais asco, te odio, nadie te quiere, nadie te aguanta, nadie te soporta, largate, vete al diablo, anda a cagar, "
    "vete a tomar por culo, chinga tu madre, chinga a tu madre, me cago en ti, me cago en tu, pierdete, vete a tu pais, vuelve a tu pais, vuelvete a tu pais, que os jodan, a callar",
    "th": "หุบปาก, ไสหัว, เงียบปาก, ไปให้พ้น, เกลียดมึง, เย็ดแม่, พ่อมึงตาย, แม่มึงตาย, ปิดปากไป, อย่าเสือก, ไม่มีใครรัก, ไม่มีใครชอบ, ไม่มีใครต้องการ, ไปลงนรก, ไปพ้น, เกลียดแก",
}
# Threats and wishes of death that need no grammar to be understood.
THREAT = {
    "en": "kill yourself, hang yourself, shoot yourself, drown yourself, off yourself, end yourself, go die, go and die, jump off a, jump off the, slit your wrists, drink bleach, deserve to die, deserves to die, hope you die, hope you get, should be shot, should be hanged, "
    "better off dead, wish you were dead, without you in it, you're dead, you are dead, you will pay for, you'll pay for, you will regret, you'll regret, watch your back, where you live, come for you, coming for you, find out where, beat you up, "
    "your days are numbered, sleep with one eye, put a bullet, bash your, your own grave, do us all a favour and, in a body bag",
    "de": "geh sterben, bring dich um, bringe dich um, bringt dich um, hang dich auf, erhang dich, spring vom, spring von, spring vor, spring aus, wirf dich vor, stirb, verreck, verrecke, krepier, du bist tot, du wirst bluten, du wirst bezahlen, wo du wohnst, wo du wohnen, "
    "mach dich fertig, machen dich fertig, mach dich kalt, knall dich ab, stech dich ab, erschiess dich, die kehle, an den galgen, an die wand stellen, schlag dich tot, hals umdrehen, das genick, kriegst du aufs maul, aufs maul, auf die fresse",
    "fr": "va mourir, va crever, creve, suicide-toi, suicide toi, tue-toi, tue toi, pends-toi, va te pendre, jette-toi, jette toi, saute du, saute par, tu vas crever, tu vas mourir, tu vas payer, tu vas saigner, ou tu habites, te faire la peau, merites de mourir, "
    "casser la gueule, casser la figure, peter la gueule, je vais te tuer, te crever les, tu es mort, t'es mort, on va te retrouver, te trancher, t'egorger, te buter, te defoncer, te massacrer",
    "es": "muerete, matate, suicidate, ahorcate, cuelgate, tirate por, tirate de, salta por, ojala te mueras, ojala mueras, te voy a matar, donde vives, vas a morir, vas a pagar, vas a sangrar, te vas a arrepentir, te arrepentiras, mereces morir, estas muerto, "
    "estas muerta, partir la cara, partirte la, romper la cara, romperte la, romper los huesos, te mato, te reviento, te rajo, te destrozo, te pego un tiro, cortarte el, vamos a por ti, voy a por ti, te vas a enterar",
    "th": "ฆ่ามึง, ฆ่าแก, จะฆ่า, กระทืบ, ไปตาย, ตายซะ, ต่อยมึง, ตบมึง, ยิงมึง, แทงมึง, เผามึง, เอาเลือดหัว, ผูกคอตาย, โดดตึก, กระโดดตึก, มึงอยู่ไหน, มึงตาย, บ้านมึงอยู่, น่าจะตาย, สมควรตาย, ฆ่าตัวตายไป, เอาให้ตาย, เก็บมึง",
}
# Verbs of violence, for the grammar of threats.
HARM = {
    "en": "kill, murder, beat, stab, shoot, strangle, smash, break, crush, burn, hurt, slit, cut, punch, choke, skin, rape, gut, bury, slap, kick, hunt, destroy, knock, rip, hang, drown, slice, whip, finish",
    "de": "tote, toten, umbringen, schlage, schlag, schlagen, verprugel, verprugeln, verprugle, steche, erstechen, erschiesse, erschiessen, wurge, wurgen, erwurgen, breche, brech, brechen, verbrenne, verbrennen, quale, zerstore, prugel, prugle, trete, treten, polier, poliere, hau, haue, hauen, zerquetsche",
    "fr": "tuer, tue, frapper, frappe, casser, casse, poignarder, etrangler, bruler, egorger, demolir, defoncer, massacrer, buter, crever, taper, tabasser, cogner, ecraser, peter, pete, detruire, violer, exploser, arracher",
    "es": "matar, mato, matarte, golpear, golpearte, romper, rompo, romperte, apunalar, apunalarte, estrangular, quemar, quemarte, degollar, partir, parto, partirte, reventar, reventarte, pegar, pegarte, destrozar, rajar, violar, aplastar, arrancarte, patear",
    "th": "ฆ่า, ตบ, ต่อย, เตะ, แทง, ยิง, เผา, กระทืบ, ซ้อม, หักคอ, บีบคอ, ฟัน, เอาตาย, ทุบ, หักขา",
}
BODY = {
    "en": "face, neck, leg, legs, arms, bones, bone, skull, head, teeth, jaw, knees, fingers, throat, nose, ribs, eyes, hands, guts, back",
    "de": "gesicht, hals, beine, bein, arme, knochen, schadel, kopf, zahne, kiefer, knie, finger, kehle, nase, rippen, augen, hande, fresse, maul, genick",
    "fr": "visage, cou, jambe, jambes, bras, os, crane, tete, dents, machoire, genoux, doigts, gorge, nez, cotes, yeux, mains, gueule, figure, nuque",
    "es": "cara, cuello, pierna, piernas, brazos, huesos, craneo, cabeza, dientes, mandibula, rodillas, dedos, garganta, nariz, costillas, ojos, manos, boca, nuca",
    "th": "หน้า, คอ, ขา, แขน, กระดูก, หัว, ฟัน, ปาก, ตา, มือ",
}
# Nouns for people by origin, belief, sex, age or health; the grammar finds others by their place in the sentence.
GROUP = {
    "en": "immigrants, immigrant, migrants, foreigners, foreigner, refugees, muslims, muslim, jews, jew, christians, hindus, arabs, arab, africans, asians, blacks, whites, black people, white people, mexicans, chinese, indians, gypsies, gays, lesbians, homosexuals, trans people, "
    "women, woman, females, girls, feminists, men, old people, the elderly, the disabled, disabled people, cripples, boomers, poor people, the poor, beggars, peasants, germans, french, poles, russians, turks, americans, southerners, northerners, believers, atheists, catholics, "
    "your kind, their kind, your people, you people, these people, those people, your lot, that lot, this lot, people like you, people like them, people like that, people from, people of, people in, people with, women in",
    "de": "auslander, migranten, fluchtlinge, muslime, moslems, juden, turken, araber, polen, schwarze, schwule, lesben, frauen, weiber, behinderte, rollstuhlfahrer, alte leute, rentner, asylanten, russen, franzosen, ossis, wessis, christen, heiden, solche leute, diese leute, "
    "euresgleichen, deinesgleichen, leute wie du, leute wie die, leute aus, menschen wie, menschen aus, menschen mit, ihr alle, die da, diese sorte, dieses pack, dieses volk",
    "fr": "etrangers, immigres, migrants, refugies, musulmans, juifs, arabes, noirs, africains, asiatiques, chinois, roms, gitans, homosexuels, gays, lesbiennes, femmes, filles, vieux, handicapes, ces gens, gens comme, gens de, gens-la, cette race, cette engeance, les pauvres, "
    "allemands, anglais, ces types, votre espece, ton espece, les bonnes femmes, croyants, toute cette bande",
    "es": "extranjeros, inmigrantes, migrantes, refugiados, musulmanes, judios, arabes, negros, moros, gitanos, chinos, homosexuales, gays, lesbianas, mujeres, viejos, ancianos, discapacitados, esa gente, esta gente, gente como, gente de, los pobres, esos tipos, esa raza, "
    "vuestra especie, tu calana, esa calana, creyentes, catalanes, latinos, africanos, las tias, feministas",
    "th": "ต่างด้าว, ผู้อพยพ, มุสลิม, อิสลาม, คนจีน, พม่า, คนลาว, คนดำ, ผู้หญิง, เกย์, กะเทย, คนแก่, คนพิการ, คนพวกนี้, คนพวกนั้น, พวกนี้, พวกมัน, พวกมึง, พวกแก, คนจน, ยิว, คนอีสาน, คนใต้, คนแบบนี้, ชาวต่างชาติ, คนต่างชาติ",
}
# What is said of a group to attack it.
ATTACK = {
    "en": "vermin, rats, cockroaches, parasites, animals, subhuman, savages, pigs, dogs, apes, monkeys, scum, filth, trash, garbage, plague, cancer, infestation, leeches, thieves, criminals, rapists, terrorists, liars, steal, stink, smell, breed, lazy, dirty, filthy, stupid, dumb, "
    "inferior, dishonest, no brain, too stupid, too dumb, too emotional, too weak, too lazy, don't belong, do not belong, doesn't belong, not welcome, go back, get out, thrown out, throw them out, kick them out, kicked out, deported, deport, exterminated, eradicated, wiped, "
    "gassed, sterilised, locked up, send them back, sent back, shipped back, not be allowed, ruin, destroy, taking over, replace us, in the kitchen, in a zoo, be trusted, trust them, can't drive, worth less, worthless, useless, primitive, backward, violent, disgusting, ruined, keep them out, hate",
    "de": "ungeziefer, ratten, parasiten, tiere, untermenschen, abschaum, dreck, mull, pest, seuche, diebe, verbrecher, vergewaltiger, terroristen, stinken, stinkt, klauen, stehlen, faul, dreckig, dumm, minderwertig, gehoren nicht, gehoren raus, gehort raus, raus, abschieben, "
    "abgeschoben, ausrotten, vergasen, vernichten, vertreiben, rausschmeissen, verschwinden, an den herd, in die kuche, hier nichts zu suchen, zu dumm, zu blod, zu faul, lugen, betrugen, einsperren, kriminell, schmarotzer, nichts wert, primitiv, ekelhaft, nicht trauen, wegsperren, hasse",
    "fr": "vermine, rats, cafards, parasites, animaux, racaille, ordures, crasse, peste, voleurs, criminels, violeurs, terroristes, puent, volent, mentent, sales, feignants, paresseux, inferieurs, stupides, dehors, expulser, expulses, exterminer, eliminer, virer, renvoyer, "
    "rentrent chez, rentrer chez, retournent chez, rien a faire ici, a la cuisine, pas leur place, profiteurs, trop betes, trop bete, trop connes, trop cons, ne valent rien, primitifs, degoutants, foutre dehors, envahissent, deteste, degout, hais, confiance",
    "es": "ratas, cucarachas, parasitos, animales, bestias, escoria, basura, plaga, ladrones, criminales, violadores, terroristas, apestan, apesta, huelen mal, huele mal, roban, robar, mienten, sucios, vagos, inferiores, tontos, tontas, fuera, expulsar, expulsados, deportar, "
    "exterminar, eliminar, echarlos, echarlas, que se vayan, a su pais, a la cocina, a fregar, no sirven, no sirve, no valen, no pertenecen, aprovechados, chusma, demasiado tontos, demasiado tontas, primitivos, invaden, asco, odio, no son de fiar",
    "th": "สัตว์, ขยะ, เชื้อโรค, ปรสิต, แมลงสาบ, เดรัจฉาน, ขี้ขโมย, ขโมย, สกปรก, เหม็น, ขี้เกียจ, โง่, ไล่ออกไป, ไล่มัน, กำจัด, ฆ่าทิ้ง, เนรเทศ, ต่ำช้า, ชั้นต่ำ, กลับประเทศ, ล้างบาง, โกหก, น่ารังเกียจ, กาฝาก, ไม่ควรอยู่, ไม่ต้อนรับ, เกลียด, ไว้ใจไม่ได้",
}
# Turns of speech that make a group of people all alike.
STEREOTYPE = {
    "en": "never trust a, never trust an, never trust the, typical of, what do you expect from, that's what you get, all the same, no place for, we don't need more, send them, they all, they always, they never, they only want, get rid of them, rid of these, too many of them, that sort, their sort, lot of them",
    "de": "was erwartest du von, alle gleich, immer dasselbe mit, die wollen nur, einer von denen, eine von denen, typisch, weg mit, brauchen wir nicht mehr, zu viele davon, nichts als, solchen ist",
    "fr": "tous les memes, toutes les memes, on n'en veut pas, c'est typique, qu'attendre de, ils ne savent que, elles ne savent que, comme tous les, trop de, pas de place pour, debarrasser de",
    "es": "todos iguales, todas iguales, que esperas de, tipico de, solo saben, no los queremos, no las queremos, siempre igual con, como todos los, demasiados, deshacernos de, no hay sitio para",
    "th": "เหมือนกันหมด, สมกับเป็น, ไม่อยากได้พวก, ก็แบบนี้แหละ, พวกมันทั้งหมด, มากเกินไปแล้ว",
}
# Words that are sexually explicit wherever they stand.
SEXUAL = {
    "en": "porn, porno, pornography, nudes, tits, titties, boobs, pussy, cock, dick, blowjob, handjob, cumshot, orgasm, horny, fuck me, fuck her, fuck him, having sex, had sex, have sex, sex with, masturbate, masturbating, masturbated, jerk off, jerking off, threesome, erection, boner, "
    "nipples, gangbang, creampie, dildo, vibrator, hentai, getting fucked, got fucked, anal sex, oral sex, sex tape, sexting, suck my, lick my, lick you, ride me, cumming, clit, topless, nude, slutty, stripper, fingering, penetrated her, deepthroat",
    "de": "porno, pornos, titten, muschi, fotze, ficken, gefickt, wichsen, orgasmus, brustwarzen, nippel, nacktbilder, nacktfotos, sex haben, hatten sex, hatte sex, sex mit, mit mir schlafen, geschlechtsverkehr, beine breit, stander, blasen lassen, schwanz lutschen, nackte, geile, geil, "
    "vogeln, bumsen, oralsex, analsex, sexfilm, hoschen, leck meine, lutsch",
    "fr": "porno, nichons, seins, baiser avec, baise, sucer, suce-moi, suce moi, branler, branlette, orgasme, tetons, jouir, sodomie, levrette, faire l'amour, coucher avec, toute nue, tout nu, photos nues, culotte, deshabille-toi, a poil, partouze, fellation, penis, chatte, "
    "bander, te baiser, me baiser, sextape, lecher",
    "es": "porno, tetas, pezones, polla, verga, follar, follando, follamos, mamada, orgasmo, masturbar, masturbarse, masturbando, masturbaba, fotos intimas, fotos desnuda, hacer el amor, acostarme contigo, acostarte conmigo, acostarse con, sexo oral, sexo anal, sexo con, cono, correrse, pene, culo, "
    "cachonda, cachondo, follarte, follarme, chuparmela, video sexual",
    "th": "เย็ด, ควย, รูปโป๊, คลิปโป๊, หนังโป๊, ภาพโป๊, เปลือยกาย, นมใหญ่, นมโต, ดูนม, จับนม, เงี่ยน, อมควย, มีเซ็กส์, มีเซ็กซ์, เซ็กส์, ร่วมเพศ, มีเพศสัมพันธ์, ช่วยตัวเอง, หัวนม, ล่อนจ้อน, น้ำแตก, ขย่ม, เสียวหี, จิ๋ม, เอากัน, ชักว่าว",
}
# Words that are so only in the right company.
BODILY = {
    "en": "naked, sex, sexy, underwear, lingerie, panties, thong, bra, strip, stripped, undress, undressed, clothes off, moan, moaning, moaned, thrust, thrusting, aroused, wet, thigh, thighs, breasts, breast, penis, vagina, kinky, fetish, bend over, on her knees, on your knees, on his knees, "
    "spread your legs, spread her legs, between her legs, between your legs, inside her, inside you, inside me, hook up, touch yourself, touched himself, touched herself, touching herself, in bed with, explicit, sleep with, hot body, my bed",
    "de": "nackt, sex, sexy, unterwasche, dessous, slip, zieh dich aus, ausziehen, auszieh, stohnen, stohnte, stohnend, feucht, erregt, schenkel, busen, bruste, penis, vagina, versaut, auf die knie, auf den knien, zwischen ihren beinen, zwischen deinen beinen, in ihr, in dir, anfassen, anfassten, lecken, arsch, ins bett",
    "fr": "nue, nu, nues, sexe, sexy, sous-vetements, lingerie, string, deshabiller, deshabille, gemir, gemissait, excitee, excite, mouillee, cuisses, fesses, vagin, a genoux, entre ses cuisses, entre tes cuisses, en elle, en moi, en toi, lit, jupe, toucher, caresser, caressait, langue, coquine",
    "es": "desnuda, desnudo, desnudas, sexo, sexy, ropa interior, lenceria, tanga, bragas, sin ropa, quitate la ropa, desnudate, gemir, gemia, gimiendo, excitada, excitado, mojada, muslos, pechos, vagina, de rodillas, entre sus piernas, entre tus piernas, dentro de ella, dentro de ti, encima de mi, cama, falda, tocarte, lamerte, verte sin",
    "th": "แก้ผ้า, เปลือย, ถอดเสื้อ, ถอดผ้า, ถอดกางเกง, กางเกงใน, ชุดชั้นใน, คราง, เสียว, บนเตียง, ต้นขา, หน้าอก, นมเธอ, นมน้อง, ขึ้นเตียง, ลูบไล้, นอนกับ, เซ็กซี่, หี",
}
# Second persons, third persons, several of them, and first persons.
SECOND = {"en": "you, your, yours, yourself, u, ur, you're, you'll", "de": "du, dich, dir, dein, deine, deinen, deiner, deinem, deines, euch, euer, eure, ihr", "fr": "tu, toi, te, ta, tes, ton, vous, votre, vos, t'es", "es": "tu, te, ti, tus, contigo, usted, ustedes, vosotros, os, vuestra, vuestro, eres, sois, vos", "th": "มึง, แก, เธอ, คุณ, เอ็ง"}
THIRD = {"en": "he, she, him, her, his, hers, they, them, their, he's, she's", "de": "er, sie, ihn, ihm, sein, seine, seinen, ihre, ihren", "fr": "il, elle, lui, son, sa, ses, eux, elles, ils, leur", "es": "ella, ellos, ellas, es una, es un, son unos, son unas", "th": "มัน, เขา, หล่อน, นาง"}
THEY = {"en": "they, them, they're, these, those", "de": "sie, denen, diese", "fr": "ils, elles, eux, ces", "es": "ellos, ellas, esos, esas, estos", "th": "มัน, พวกมัน, พวกนี้"}
FIRST = {"en": "i am, i'm, i feel, i felt, i was, feel like, felt like, my own, am i, sorry, i look, my stupid, myself, silly me", "de": "ich bin, ich war, ich fuhl, mein eigener, meine eigene, mein blod, entschuldig, sorry, fuhle mich, mich wie", "fr": "je suis, j'etais, je me sens, ma propre, mon propre, desole, pardon, excuse", "es": "soy, estoy, me siento, mi propio, mi propia, lo siento, perdon, perdona, yo era", "th": "ผมมัน, ฉันมัน, ตัวเองโง่, ขอโทษ, รู้สึกว่าตัวเอง"}
# Words of the trade, in which the others have harmless meanings.
TECHNICAL = {
    "en": "process, processes, thread, signal, daemon, server, container, kernel, branch, commit, script, job, jobs, query, cluster, node, database, cache, disk, worker, parent, child, orphan, sigkill, sigterm, build, deploy, pipeline, test, tests, pointer, loop, code, log, logs, port, host, "
    "exploit, payload, firewall, attacker, column, field, table, index, cursor, read, write, bit, page, packet, socket, session, token, switch, fork, replica, master, slave, ram, heap, cpu, parser, regex, module, release, version, ticket, bug, git, blame, cookie, request, penetration test, site",
    "de": "prozess, kindprozess, elternprozess, dienst, skript, abfrage, knoten, datenbank, festplatte, protokoll, speicher, zweig, zeiger, schleife, code, server, cluster, zeile, spalte, tabelle, signal, sicher, konfiguration, fehler, version, seite, paket, anfrage, wartung, replikat",
    "fr": "processus, noeud, serveur, base de donnees, requete, memoire, disque, branche, pointeur, boucle, code, journal, journaux, script, grappe, signal, colonne, tableau, esclave, maitre, erreur, version, page, fichier, paquet, sauvegarde, fils, thread",
    "es": "proceso, nodo, servidor, base de datos, consulta, memoria, disco, rama, puntero, bucle, codigo, registro, registros, script, senal, columna, tabla, esclavo, esclava, maestro, error, version, pagina, fichero, paquete, copia, hijo, hilo, replica",
    "th": "โปรเซส, เซิร์ฟเวอร์, ฐานข้อมูล, คิวรี, โค้ด, ระบบ, สคริปต์, คลัสเตอร์, โหนด, แคช, ดิสก์, ล็อก, เวอร์ชัน, บั๊ก, ซอมบี้, เธรด, คอลัมน์, ตาราง",
}
# Rules and reports that speak about such words.
MENTION = {
    "en": "the word, words like, word list, the term, the phrase, blocklist, blacklist, filter, policy, policies, code of conduct, guideline, guidelines, moderation, moderator, moderators, not allowed, not tolerated, tolerate, prohibited, forbidden, banned, removed, report, reported, reports, complaint, "
    "harassment, hate speech, abuse, abusive, insult, insults, slur, slurs, such as, education, training, awareness, prevention, history, study, research, survey, article, victim, victims, screening, health, rule, rules, flagged, classifier, profanity, offensive",
    "de": "das wort, worter wie, wortliste, begriff, begriffe, filter, richtlinie, richtlinien, verhaltenskodex, moderation, moderator, nicht erlaubt, verboten, untersagt, gesperrt, sperrt, entfernt, gemeldet, meldung, bericht, beschwerde, belastigung, hassrede, beleidigung, beleidigungen, schulung, aufklarung, regel, regeln, forschung, studie, opfer",
    "fr": "le mot, les mots, mots comme, terme, termes, filtre, charte, regle, regles, moderation, moderateur, moderateurs, interdit, interdits, interdite, proscrit, supprime, signale, signalement, rapport, plainte, harcelement, haineux, insulte, insultes, formation, prevention, etude, recherche, victime, victimes, tels que",
    "es": "la palabra, palabras como, termino, terminos, filtro, norma, normas, politica, moderacion, moderador, moderadores, prohibe, prohibido, prohibidos, prohibidas, no se permite, no se permiten, eliminado, denunciado, denuncia, informe, queja, acoso, insulto, insultos, formacion, educacion, prevencion, estudio, victima, regla, reglas, tales como",
    "th": "คำว่า, คำหยาบ, นโยบาย, กฎ, ห้าม, ตัวกรอง, รายงาน, ร้องเรียน, คุกคาม, ผู้ดูแล, ถูกลบ, อบรม, คำพูดแสดงความเกลียดชัง, งานวิจัย, ไม่อนุญาต",
}
# Other meanings of single words, by which a search for abuse is often misled.
COMPOUND = {
    "en": "kill switch, kill command, kill -9, dirty read, dirty page, dirty bit, dirty flag, dummy data, dummy variable, dumb terminal, dumb pipe, garbage collection, garbage collector, trash folder, naked pointer, naked eye, naked domain, brute force, man in the middle, zombie process, git blame, "
    "middlesex, essex, sussex, scunthorpe, cockpit, cocktail, cross-site, rat race, guinea pig, hot dog, dog food, dogfooding, keep it simple, idiot-proof, idiot proof, foolproof, bastard operator, sex education, breast cancer, lame duck, snake case, worm drive, monkey patch, "
    "monkey testing, chaos monkey, fat client, fat jar, fat pointer, sick leave, lazy loading, lazy evaluation, male connector, female connector, master slave, attack surface, dead letter, deadlock, dead code, suicide prevention",
    "de": "idiotensicher, mullabfuhr, tierarzt, krebsvorsorge, tote verweise, tote links, faule auswertung, schwanzrekursion, sexualkunde, brustkrebs, affentest, dummydaten, fett gedruckt, null wert, nullwert, hundefutter, sussex",
    "fr": "base de test, clef etrangere, cle etrangere, processus zombie, ramasse-miettes, education sexuelle, cancer du sein, chien de garde, evaluation paresseuse, sussex",
    "es": "clave foranea, clave extranjera, proceso zombi, recolector de basura, educacion sexual, cancer de mama, perro guardian, evaluacion perezosa, a prueba de idiotas, a prueba de tontos, sussex",
    "th": "โปรเซสซอมบี้, มะเร็งเต้านม, เพศศึกษา, ถังขยะ, นมสด, นมวัว, นมผง, ชานม, สัตว์เลี้ยง, สัตวแพทย์",
}


def forms(word: str, language: str) -> list[str]:
    """A Latin entry with the usual endings of its language."""
    if " " in word or language in ("th", "en") or len(word) < 3:
        return [word, word + "s"] if language == "en" and " " not in word and len(word) > 2 else [word]
    if language == "de":
        return [word, *(word + e for e in ("e", "en", "er", "es", "em", "n", "s"))]
    if language == "fr":
        return [word, *(word + e for e in ("s", "e", "es", "x"))]
    stem = word[:-1]
    return [word, word + "s", word + "es", *(stem + e for e in ("o", "a", "os", "as") if word[-1] in "oa"), *([word + "a", word + "as"] if word[-1] in "rn" else [])]


def entries(lexicon: dict[str, str]) -> set[str]:
    """All forms of all entries of a lexicon."""
    return {f for language, words in lexicon.items() for w in words.split(",") if w.strip() for f in forms(w.strip(), language)}
