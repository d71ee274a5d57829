"""Fixed values for the abuse classifier: look-alike characters, substitutes and seed sentences in several languages."""

# Look-alike letters of other scripts and the Latin letters they imitate.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ⅼ": "l", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ԝ": "w", "ѵ": "v", "з": "z",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a",
}

# Signs that stand for letters, and the letters they may stand for.
SUBSTITUTES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "il", "|": "li", "+": "t",
}

# Sentences that insult, threaten, degrade or solicit.
ABUSIVE = """
you are an idiot
you are a stupid fool and nobody likes you
shut up you moron
shut your mouth you pathetic loser
you are worthless trash
what a disgusting pig you are
you dumb piece of garbage
you stupid bitch
you filthy animal
fuck you
go fuck yourself asshole
you are a piece of shit
get lost you ugly freak
nobody wants you here, leave
you make me sick, you coward
only an imbecile like you would write this
your mother should be ashamed of you, you cretin
kill yourself
go die
i will kill you
i will find you and hurt you
i know where you live and i will break your legs
watch your back i am coming for you
you will regret this, i will beat you
somebody should punch you in the face
you will pay with your blood
those people are vermin and should be exterminated
these migrants are all thieves and parasites
they are subhuman and do not belong here
the only good ones are dead ones
send them all back, filthy rats
we should wipe them out
keep them away from us, they are all criminals
no wonder, they are born liars
people of that faith are animals and should not be allowed to live
women like you belong in the kitchen, stupid whore
send me nudes
show me your tits
i want to have sex with you
i want to see you naked
come to my bed you sexy slut
hot girls in your area want sex tonight
watch free porn videos xxx
cheap escorts full sex service
she moaned while he fucked her
suck my dick
hardcore sex tapes uncensored
idiot
moron
loser
scum
du bist ein idiot
halt die fresse du dumme sau
halt dein maul du arschloch
verpiss dich du wichser
du bist wertloser abschaum
fick dich
ich bringe dich um
ich weiss wo du wohnst
dieses ungeziefer gehört ausgerottet
die sollte man alle vergasen
schick mir nacktbilder du schlampe
ich will mit dir ficken
geile frauen warten auf dich
ferme ta gueule espèce de connard
tu es un crétin et un imbécile
va te faire foutre
sale pute
je vais te tuer
je sais où tu habites
cette vermine doit disparaître
ce sont tous des voleurs, dehors
envoie tes photos nue
je veux coucher avec toi
nique ta mère
eres un imbécil y un inútil
cállate pedazo de basura
vete a la mierda hijo de puta
te voy a matar
sé dónde vives
esas ratas deberían morir
hay que echarlos a todos al mar
mándame fotos desnuda
quiero sexo contigo esta noche
você é um lixo de pessoa
cala a boca seu idiota
vai se foder filho da puta
vou te matar
essa gente é uma praga, fora daqui
manda fotos nua
quero transar com você
ты идиот
заткнись тупая скотина
пошёл ты на хуй
я тебя убью
этих тварей надо уничтожить
пришли голые фото
хочу с тобой секса
你是个白痴
闭嘴你这个废物
去死吧
我要杀了你
滚出去你们这些垃圾
发裸照给我
我想和你上床
""".strip().splitlines()

# Sentences that use such words without abusing anyone.
HARMLESS = """
i was an idiot and forgot to set the seed
i am so stupid, i mixed up the columns
this stupid separator cost me hours
the dumb baseline predicts the median
this column is useless for the model
the garbage collector ran twice
the code is ugly but it works
that is a terrible chart, please fix the axis
kill the process when it hangs
the kernel dies after a while
drop dead rows before joining
naked mole rats were weighed every week
rat and pig genomes aligned
pest control data on vermin and traps
parasite counts per fish
breast cancer screening rates for women
the sex column is coded as male and female
the survey asks about sexual health and contraception
sex education in schools by district
the paper studies slurs against minorities and how editors condemned them
comments labelled for insult, threat and obscene speech
the column marks comments that moderators removed as abusive
a model that detects porn in images
crime records of assault, threat and hate offences
the share of hateful rows is small
deaths and injuries per year
hate speech detection benchmark
murder rates by city
the attack was reported by the police
nude is a colour name in the catalogue
thank you for sharing this clean data
the licence lets you reuse the files
ich war ein idiot und habe es vergessen
die tabelle enthält alle zeilen
j'ai été idiot, désolé
merci pour ce jeu de données
fui un idiota, perdón por el ruido
gracias por compartir los datos
obrigado pela coleção
спасибо за полезный набор данных
感谢分享这个数据集很有用
""".strip().splitlines()
