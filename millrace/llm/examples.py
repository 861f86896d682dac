"""Example sentences, ours, that a model is fitted on beside the judged reviews, so that a few judgements already make a usable one."""

EXAMPLES = [
    ("You are an idiot and a moron.", "abusive"), ("Shut up, you stupid loser.", "abusive"), ("The courier is a complete imbecile.", "abusive"), ("I will hurt you and break your bones.", "abusive"),
    ("Drop dead, you worthless scumbag.", "abusive"), ("The person at support is a brainless cretin.", "abusive"), ("Nobody likes you, you pathetic worm.", "abusive"), ("I know where you live and I will beat you up.", "abusive"),
    ("Whoever wrote this review is a dimwit.", "abusive"), ("Go kill yourself, nobody will miss you.", "abusive"), ("What a bunch of morons, the sellers are parasites.", "abusive"), ("I hope you choke on it.", "abusive"),
    ("Du bist ein Idiot und ein Trottel.", "abusive"), ("Halt die Klappe, du Versager.", "abusive"), ("Der Verkäufer ist ein Schwachkopf.", "abusive"), ("Ich schlage dir die Zähne ein.", "abusive"), ("Verreck doch, du Vollpfosten.", "abusive"),
    ("Tu es un abruti et un minable.", "abusive"), ("Ferme-la, espèce d'idiot.", "abusive"), ("Le vendeur est un imbécile.", "abusive"), ("Va crever, je vais te casser la figure.", "abusive"),
    ("Eres un imbécil y un payaso.", "abusive"), ("Cállate, idiota.", "abusive"), ("El vendedor es un inútil y un estúpido.", "abusive"), ("Ojalá te mueras, te voy a partir la cara.", "abusive"),
    ("Foreigners are vermin and must be thrown out.", "hateful"), ("Women are too stupid to use this.", "hateful"), ("Immigrants are animals and deserve no rights.", "hateful"), ("Get rid of all disabled people, they are filth.", "hateful"),
    ("Gays are a plague on this country.", "hateful"), ("Old people are cockroaches and should be locked in a cage.", "hateful"), ("This town was better before those people came.", "hateful"), ("All believers are liars by blood.", "hateful"),
    ("Ausländer sind Ungeziefer und gehören rausgeworfen.", "hateful"), ("Frauen sind Abschaum.", "hateful"), ("Behinderte haben hier nichts verloren.", "hateful"), ("Typisch Schwule, alles Untermenschen.", "hateful"),
    ("Les étrangers sont des rats, il faut les chasser.", "hateful"), ("Les femmes ne méritent aucun droit.", "hateful"), ("Les vieux sont de la vermine.", "hateful"),
    ("Los extranjeros son ratas y hay que echarlos.", "hateful"), ("Las mujeres no merecen vivir aquí.", "hateful"), ("Los viejos son basura y mienten por naturaleza.", "hateful"),
    ("Send me nudes tonight.", "sexual"), ("Hot naked women waiting, free porn videos.", "sexual"), ("We had sex on it all night and I came hard.", "sexual"), ("It makes me horny and I want to undress.", "sexual"), ("He licked me until I had an orgasm.", "sexual"), ("She took all of me in her mouth, naked.", "sexual"), ("Looking for blowjobs, write to me.", "sexual"),
    ("Schick mir Nacktbilder.", "sexual"), ("Wir hatten die ganze Nacht wilden Sex.", "sexual"), ("Das macht mich geil, ich ziehe mich nackt aus.", "sexual"), ("Gratis Pornos und Sexvideos.", "sexual"),
    ("Envoie-moi des photos nue.", "sexual"), ("On a baisé toute la nuit.", "sexual"), ("Vidéos de sexe et porno gratuits.", "sexual"),
    ("Mándame fotos desnuda.", "sexual"), ("Follamos toda la noche.", "sexual"), ("Porno y vídeos de sexo gratis.", "sexual"),
    ("The instructions are idiot proof.", "none"), ("This product is pure rubbish and the seal is stupid.", "none"), ("The killer feature is the battery, a wicked good deal.", "none"), ("The cock crows on the clock and the breast pocket is handy.", "none"),
    ("My review was removed because I quoted the word idiot.", "none"), ("The seller was rude but refunded me.", "none"), ("Women and men both like it, and so do old people.", "none"), ("The sex of the kitten is not stated on the label.", "none"), ("A bastard file and a dumb bell came with it.", "none"),
    ("Die Anleitung ist idiotensicher.", "none"), ("Brutal gut, ein geiles Gerät.", "none"), ("Meine Frau und meine Oma mögen es.", "none"), ("Ein Killer-Preis für diese verdammte Bohrmaschine.", "none"),
    ("Un prix idiot, mais le couvercle est stupide.", "none"), ("Ma mère, une femme âgée, est ravie.", "none"), ("Ce produit est nul.", "none"), ("Mi abuela y otras mujeres lo usan.", "none"), ("El precio es ridículo y la tapa una basura.", "none"), ("Una tienda para gente mayor, muy buena.", "none"),
]
