"""Names, titles and cues of people, by script, for ``pii``."""

from __future__ import annotations

TITLES = {
    "m": "Mr Mister Herr Monsieur M Señor Sr Don Signor Sir Lord Господин Г-н Κύριος Κος Pan Meneer".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Mademoiselle Señora Sra Señorita Srta Doña Signora Lady Госпожа Г-жа Κυρία Κα Pani Mevrouw".split(),
    "n": "Dr Doctor Prof Professor Rev Доктор Профессор".split(),
}
#: Titles that are also written in capitals; those of the rest are ordinary words.
CAPITAL = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra".split()

GIVEN = {
    ("latin", "m"): """Aaron Adam Adrian Alan Albert Alejandro Alexander Alfred Ali Andreas Andrew Anthony Anton Antonio Arthur Benjamin Bernard Brian Bruno Carl Carlos Cedric Charles Christian Christopher
Daniel David Denis Diego Dieter Dominic Donald Douglas Edgar Eduardo Edward Emil Enrique Eric Erik Ethan Fabian Felipe Felix Ferdinand Fernando Francis Francisco Frank Frederick Friedrich Gabriel Gary George Gerald Gerhard Giovanni Giuseppe Gregory Guillaume
Gustav Hans Harold Harry Heinrich Helmut Henri Henry Hugo Ian Igor Ivan Jack Jacob Jacques Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Joachim Johannes John Jonas Jonathan Jorge Jose José Joseph Joshua Juan Julien Jürgen
Karl Keith Kenneth Kevin Klaus Kurt Lars Laurent Leon Liam Lorenzo Louis Luca Lucas Ludwig Luigi Luis Lukas Manuel Marc Marco Marek Mario Martin Mateo Matteo Matthew Max Maximilian Michael Michel Miguel Mohamed Mohammed Nathan Nicholas Nicolas Niklas Nils Oliver Olivier
Oscar Otto Pablo Pascal Patrick Paul Pavel Pedro Peter Philip Philippe Pierre Piotr Rafael Ralph Raymond René Ricardo Richard Robert Roberto Roger Roland Ronald Rudolf Samuel Scott Sebastian Sergio Simon Stefan Stephen Steven Sven Theodore Thomas Timothy Tobias Tomasz
Uwe Victor Vincent Walter Werner William Wolfgang Xavier Yannick Yusuf Zachary""",
    ("latin", "f"): """Agnes Alice Alicia Amanda Amelia Amélie Amy Ana Andrea Angela Anita Anja Anna Anne Annette Antonia Barbara Beatrice Beatriz Birgit Brigitte Camille Carla Carmen Carol Caroline Catherine Cecilia Chantal Charlotte Christina Christine Claire Clara Claudia
Cristina Cynthia Daniela Deborah Diana Dolores Donna Dorothea Dorothy Eleanor Elena Elisa Elizabeth Ella Ellen Elsa Emily Emma Esther Eva Evelyn Fatima Florence Françoise Franziska Frida Gabriela Genevieve Gloria Greta Hanna Hannah Heather Heidi Heike Helen Helena Hélène
Inès Ines Ingrid Irene Isabel Isabella Isabelle Jana Jane Janet Jennifer Jessica Joan Johanna Josefina Joyce Judith Julia Juliette Karen Karin Katarzyna Katharina Kathleen Katrin Kimberly Laura Lauren Léa Lena Leonie Linda Lisa Lucia Lucía Luisa Lydia Madeleine Margaret
Margarita Maria María Mariana Marianne Marie Martha Martina Mary Mathilde Megan Melissa Mercedes Mia Michelle Miriam Monica Monika Nadia Nancy Natalia Natalie Nathalie Nicole Nina Nora Olga Olivia Pamela Patricia Paula Petra Pilar Rachel Raquel Rebecca Regina Renate Rita Rosa Rosario
Ruth Sabine Sabrina Sandra Sara Sarah Silvia Simone Sofia Sofía Sonia Sophia Sophie Stefanie Stephanie Susan Susanne Svenja Sylvie Teresa Theresa Ursula Valentina Valeria Valérie Vanessa Vera Veronica Véronique Victoria Virginia Yolanda Yvonne Zoe""",
    ("latin", "n"): "Alex Ariel Bailey Casey Charlie Dominique Drew Jamie Jordan Kim Lee Morgan Noa Quinn Riley Robin Sascha Taylor Tony",
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Антон Борис Вадим Василий Виктор Виталий Владимир Григорий Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Леонид Максим Михаил Никита Николай Олег Павел Пётр Роман Руслан Сергей Степан Тимофей Фёдор Юрий",
    ("cyrillic", "f"): "Александра Алёна Алина Анастасия Анна Валентина Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета Жанна Зоя Инна Ирина Ксения Лариса Любовь Людмила Марина Мария Надежда Наталья Нина Оксана Ольга Полина Светлана София Софья Тамара Татьяна Юлия",
    ("cyrillic", "n"): "Валя Женя Саша Слава",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνης Βασίλης Γιάννης Γιώργος Δημήτρης Θανάσης Ιωάννης Κώστας Λευτέρης Μανώλης Μιχάλης Νίκος Παναγιώτης Παύλος Πέτρος Σπύρος Σταύρος Χρήστος",
    ("greek", "f"): "Αγγελική Αικατερίνη Αναστασία Άννα Βασιλική Γεωργία Δέσποινα Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κατερίνα Κωνσταντίνα Μαρία Παναγιώτα Σοφία Φωτεινή Χριστίνα",
    ("arabic", "m"): "أحمد إبراهيم حسن حسين خالد سالم سعيد سمير صالح طارق عادل علي عمر فيصل كريم ماجد محمد محمود مصطفى ناصر هشام وليد ياسر يوسف",
    ("arabic", "f"): "آمنة أسماء أمل إيمان خديجة دينا رانيا ريم زينب سارة سعاد سلمى سميرة عائشة فاطمة لطيفة ليلى مريم منى نادية نور هدى هند ياسمين",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
#: Given names of Han script are one or two of these characters.
HAN_GIVEN = {"m": "伟强磊军洋勇杰涛超明刚平辉鹏华飞鑫波斌宇浩凯健俊帆帅旭宁龙林", "f": "芳娜敏静丽娟艳秀霞玲燕洁梅雪慧莉倩颖琳婷妍萍红玉兰凤岚薇菲莹", "n": "安文佳思晨晓乐一欣瑞"}
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
HAN_DOUBLE = "欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐".split()

#: Beginnings, middles and ends of made family names.
SYLLABLES = {
    "latin": ("Bar Bel Bran Cal Dor El Fal Gar Hal Kel Lan Mar Nor Or Par Ral Sal Tor Val Wel".split(), "a e i o u an en in on".split(), "berg bert dale field ford hart holm lund man mann mont ner sen son stein ton well wick".split()),
    "cyrillic": ("Бел Вол Гор Дол Зар Кар Лес Мор Нов Пол Сав Тар".split(), "а е и о у ан ен".split(), "ин ов ев ынов нов кин".split()),
    "greek": ("Αλ Βελ Γαλ Δελ Καρ Λαμ Μαρ Νικ Παπ Σαρ".split(), "α ε ι ο".split(), "ίδης όπουλος άκης ίου".split()),
    "arabic": ("ال".split(), "با تا را سا شا فا قا كا لا نا ها".split(), "ري مي دي لي ني زي سي".split()),
}
#: Ends of family names that tell a person after another capitalised word.
FAMILY_END = "ski ska sky skaya cki cka wicz vich vić vic ević enko chuk czyk czak ov ova ev eva yev son sen ssen sson sdóttir dottir mann berg stein ez elli ini escu oglu yan ian idis opoulos akis wala ashvili adze quist strand lund ström ström holm велл ов ова ев ева ёв ёва ин ина ский ская енко чук ович вич όπουλος ίδης άκης".split()
#: Words after a given name, or before a family name, that make a place, firm, day or month of it.
PLACE = """street st avenue road lane square park hospital university college school church station airport bridge river lake island islands valley county city town inc ltd llc corp gmbh company group bank hotel museum palace tower house center centre institute foundation award prize cup
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember
the and or of in on at for from with this that these those it he she they we you i new north south east west northern southern eastern western university straße strasse platz allee rue calle avenida plaza san santa saint st""".split()
PARTICLES = "de da do dos das del della di du la le van von der den ter ten zu bin ibn al el y e".split()

#: What comes right before a name, in lower case.
CUES = """my name is|name is|name:|named|full name:|contact:|contact person:|attn:|attn.|attention:|dear|sincerely,|regards,|signed,|signed by|author:|patient:|customer:|client:|employee:|born|née
mein name ist|ich heiße|name:|kontakt:|ansprechpartner:|unterzeichnet:|liebe|lieber|je m'appelle|je m’appelle|mon nom est|nom:|signé:|cher|chère|me llamo|mi nombre es|nombre:|firmado:|querido|querida|estimado|estimada
меня зовут|имя:|фио:|контакт:|με λένε|όνομα:""".replace("\n", "|").split("|")
HAN_CUES = "我叫|我是|名叫|姓名[:：]|联系人[:：]|名字是|名字叫"
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "老师": "n", "教授": "n", "医生": "n", "博士": "n", "经理": "n"}
ARABIC_TITLES = {"السيد": "m", "الأستاذ": "m", "السيدة": "f", "الآنسة": "f", "الأستاذة": "f", "الدكتور": "m", "الدكتورة": "f"}
ARABIC_CUES = "اسمي|يدعى|تدعى|الاسم:|الاسم :"
