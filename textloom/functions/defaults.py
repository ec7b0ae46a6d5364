"""What a run takes where the caller names nothing else: short word lists and sample sentences of our own for Spanish, Portuguese and English.

They are small on purpose; files given by the caller take their place as a whole.
"""

from __future__ import annotations

from textloom.functions.lexicons import SentimentLexicon

_SHARED = "amp com gracias hello hola http https jaja jajaja kkk lol love nice ola por favor post reel thanks www".split()
STOPWORDS: dict[str, list[str]] = {
    "es": sorted({*_SHARED, *"al algo así aunque cada como con cuando de del desde donde el ella ellas ellos en era es esa ese eso esta este esto está están fue ha han hasta hay la las le les lo los más me mi mis muy ni no nos nuestra nuestro para pero por porque que qué quien se ser si sí sin sobre son su sus también te tiene toda todas todo todos tu tus un una uno unos y ya yo".split()}),
    "pt": sorted({*_SHARED, *"ao aos as até com como da das de dela dele do dos ela elas ele eles em era essa esse esta este eu foi há isso já lhe mais mas me meu minha muito na nas nem no nos não ou para pela pelo por quando que quem se sem ser seu sua são também te tem uma um você vocês".split()}),
    "en": sorted({*_SHARED, *"about all also and any are because been but can could did does for from had has have her him his how its just more not now our out she some than that the their them then there these they this those too was were what when where which who why will with would you your".split()}),
}

SENTIMENT = SentimentLexicon(
    positive={
        "es": "amor apoyo bien bonita bonito excelente feliz fuerza genial gran hermosa hermoso increíble justicia libre libertad linda lindo maravilloso mejor orgullo respeto valiente verdad".split(),
        "pt": "amor apoio bom bonita bonito coragem excelente feliz força incrível justiça liberdade linda lindo melhor orgulho ótimo respeito verdade".split(),
        "en": "amazing beautiful best brave excellent free freedom good great happy justice love proud respect strong support true wonderful".split(),
    },
    negative={
        "es": "abuso acoso asco asesino basura cobarde culpa dolor enferma enfermo feo horrible mal malo mentira miedo muerte odio peor terrible triste vergüenza violencia".split(),
        "pt": "abuso assédio covarde culpa dor feio horrível lixo mal mau medo mentira morte nojo ódio pior terrível triste vergonha violência".split(),
        "en": "abuse afraid awful bad coward death disgusting fear hate horrible lie pain sad sick terrible trash ugly violence worst wrong".split(),
    },
    negators="no ni nunca jamás sin não nem nunca sem not never without don't isn't can't".split(),
    intensifiers="muy tan súper demasiado muito super tão very so really extremely".split(),
    emoji_positive=list("😀😁😂😊😍🥰👏👍💪✨") + ["❤️"],
    emoji_negative=list("😡😠🤬😢😭💔👎🤮😱"),
)

#: Everyday sentences from which trigrams of a language can be counted before any text of the corpus is known.
SENTENCES: dict[str, list[str]] = {
    "es": [
        "La ciudad despierta temprano y la gente camina hacia el trabajo mientras los niños van a la escuela con sus mochilas.",
        "Ayer por la tarde hablamos con los vecinos sobre el agua, la luz y el precio de las cosas en el mercado.",
        "No sé qué va a pasar mañana, pero espero que todos estén bien y que podamos volver a casa sin problemas.",
        "Las mujeres del barrio pidieron justicia porque nadie había escuchado sus denuncias durante muchos años.",
        "Me gusta leer cuando llueve, tomar café con leche y escuchar la música que ponía mi abuelo los domingos.",
        "El gobierno dijo que cambiaría la ley, aunque muchas personas creen que nada de eso será suficiente.",
        "¿Quién puede decir que esto es normal? Hay que pensar en los hijos, en la salud y en el respeto entre las personas.",
        "Los hombres también tienen que aprender a escuchar, a cuidar y a decir lo que sienten sin vergüenza.",
        "Desde entonces trabajamos juntos en un proyecto nuevo que ayuda a quienes más lo necesitan en nuestra comunidad.",
        "Este comentario es muy cierto, ojalá más gente lo entendiera y dejara de juzgar a los demás por lo que llevan puesto.",
    ],
    "pt": [
        "A cidade acorda cedo e as pessoas caminham para o trabalho enquanto as crianças vão para a escola com as suas mochilas.",
        "Ontem à tarde conversamos com os vizinhos sobre a água, a luz e o preço das coisas no mercado.",
        "Não sei o que vai acontecer amanhã, mas espero que todos estejam bem e que possamos voltar para casa sem problemas.",
        "As mulheres do bairro pediram justiça porque ninguém tinha ouvido as suas denúncias durante muitos anos.",
        "Gosto de ler quando chove, de tomar café com leite e de ouvir a música que o meu avô punha aos domingos.",
        "O governo disse que mudaria a lei, embora muitas pessoas achem que nada disso será suficiente.",
        "Quem pode dizer que isto é normal? É preciso pensar nos filhos, na saúde e no respeito entre as pessoas.",
        "Os homens também precisam aprender a escutar, a cuidar e a dizer o que sentem sem vergonha.",
        "Desde então trabalhamos juntos em um projeto novo que ajuda quem mais precisa na nossa comunidade.",
        "Este comentário é muito verdadeiro, tomara que mais gente entendesse e deixasse de julgar os outros pela roupa que vestem.",
    ],
    "en": [
        "The city wakes up early and people walk to work while the children go to school with their bags.",
        "Yesterday afternoon we talked with the neighbours about the water, the light and the price of things at the market.",
        "I do not know what will happen tomorrow, but I hope that everyone is well and that we can get back home without trouble.",
        "The women of the district asked for justice because nobody had listened to their reports for many years.",
        "I like to read when it rains, to drink coffee with milk and to hear the music that my grandfather played on Sundays.",
        "The government said it would change the law, although many people think that none of this will be enough.",
        "Who can say that this is normal? We have to think about the children, about health and about respect between people.",
        "Men also have to learn how to listen, how to care and how to say what they feel without shame.",
        "Since then we have been working together on a new project which helps those who need it most in our community.",
        "This comment is so true, I wish more people would understand it and stop judging others by what they are wearing.",
    ],
}
