"""Word lists of the detectors, whole: given names, surnames, cities and famous people."""

from __future__ import annotations

GIVEN_NAMES = tuple(
    "абай абдулла абрам август авдей авксентий авраам авраамий автоном агап агафон ада адам аделаида аделина адриан азалия азарий азат аида аким "
    "аксентий аксинья аладин алан алевтина александр александра алексей алина алиса алла альберт альбина альфред амалия анастасия анатолий "
    "ангелина андрей андриан анжела аникита анисим анна антип антон антонина анфим анфиса аполлинарий аполлон арина аристарх аркадий арсений "
    "артем артём артемий артур архип аскольд ася афанасий белла бенедикт богдан борис борислав бронислав вавила вадим валентин валентина валериан "
    "валерий валерия варвара варлам варфоломей василий василиса венедикт вениамин вера вероника викентий виктор виктория вилен виолетта виталий "
    "владилен владимир владислав владислава владлен влас вольдемар всеволод вячеслав гавриил галактион галина георгий герасим герман глафира глеб "
    "гордей григорий давид дамир дана даниил данил данила данислав дарина дарья дементий демид демьян денис диана димитрий дина динара дмитрий "
    "добрыня донат дорофей евгений евгения евграф евдоким евдокия евсей евстафий егор екатерина елена елизавета елизар елисей емельян епифан "
    "ермолай ерофей ефим ефрем ефросинья жанна зарина захар зинаида зиновий злата зосима зоя иван игнат игнатий игорь иларион илья инга инна "
    "иннокентий иосиф ипполит ирина ириней исидор ия казимир капитолина капитон карина карп касьян ким киприан кира кирилл клавдия климент "
    "кондрат кондратий конон константин корней ксения кузьма лавр лаврентий лада лазарь лариса лев леонид леонтий лидия лилия лина логин лука "
    "любовь людмила майя макар максим максимилиан маргарита марианна марина мария марк маркел марта мартын марфа матвей мефодий мечислав милан "
    "милана милена мирон мирослав мирослава митрофан михаил модест моисей мстислав надежда назар наталья наум нелли нестор никанор никита никифор "
    "никодим николай нил нина нифонт нонна оксана олег олеся ольга остап павел паисий панкрат пантелей парамон пафнутий пахом петр пётр платон "
    "поликарп полина порфирий прасковья прокофий прохор рада радион раиса ратибор рафаил регина рената римма родион роза роксана роман ростислав "
    "руслан руслана савва савелий самуил светлана святослав севастьян семен семён серафим серафима сергей сидор сила сильвестр снежана созонт "
    "сократ соломон софия софья спиридон станислав стелла степан таисия тамара тарас татьяна терентий тимофей тимур тит тихон трофим ульяна устин "
    "фаина федор фёдор федот феликс филарет филат филипп фома фрол харитон христиан эвелина эдуард эльвира эмилия эмиль эмма эрик юлиан юлия юна "
    "юрий юстин яков ян яна ярослав ярослава".split()
)
SURNAMES = tuple(
    "иванов смирнов кузнецов попов васильев петров соколов михайлов новиков фёдоров морозов волков алексеев лебедев семёнов егоров павлов козлов "
    "степанов николаев орлов андреев макаров никитин захаров зайцев соловьёв борисов яковлев григорьев романов воробьёв сергеев кузьмин фролов "
    "александров дмитриев королёв гусев киселёв ильин максимов поляков сорокин виноградов ковалёв белов медведев антонов тарасов жуков баранов "
    "филиппов комаров давыдов беляев герасимов богданов осипов сидоров матвеев титов марков миронов крылов куликов карпов власов мельников "
    "денисов гаврилов тихонов казаков афанасьев данилов савельев тимофеев фомин чернов абрамов мартынов ефимов федотов щербаков назаров калинин "
    "исаев чернышёв быков маслов родионов коновалов лазарев воронин климов филатов пономарёв голубев кудрявцев прохоров наумов потапов журавлёв "
    "овчинников трофимов леонов соболев ермаков колесников гончаров емельянов никифоров грачёв котов гришин ефремов архипов громов кириллов "
    "малышев панов моисеев румянцев акимов кондратьев бирюков горбунов анисимов еремеев тихомиров галкин лукьянов михеев скворцов юдин белоусов "
    "нестеров симонов прокофьев харитонов князев".split()
)
TOWNS = tuple(
    "москва, санкт-петербург, новосибирск, екатеринбург, казань, нижний новгород, челябинск, самара, омск, ростов-на-дону, уфа, красноярск, "
    "воронеж, пермь, волгоград, краснодар, саратов, тюмень, тольятти, ижевск, барнаул, ульяновск, иркутск, хабаровск, ярославль, владивосток, "
    "махачкала, томск, оренбург, кемерово, новокузнецк, рязань, астрахань, набережные челны, пенза, липецк, киров, чебоксары, тула, калининград, "
    "балашиха, курск, севастополь, сочи, ставрополь, улан-удэ, тверь, магнитогорск, иваново, брянск, белгород, сургут, владимир, нижний тагил, "
    "архангельск, чита, симферополь, калуга, смоленск, волжский, якутск, саранск, череповец, курган, вологда, орёл, владикавказ, подольск, "
    "грозный, мурманск, тамбов, петрозаводск, стерлитамак, нижневартовск, кострома, новороссийск, йошкар-ола, химки, таганрог, "
    "комсомольск-на-амуре, сыктывкар".split(", ")
)
FAMOUS_PEOPLE = tuple(
    "александр пушкин, лев толстой, фёдор достоевский, михаил лермонтов, николай гоголь, антон чехов, иван тургенев, сергей есенин, владимир "
    "маяковский, анна ахматова, марина цветаева, борис пастернак, михаил булгаков, пётр чайковский, дмитрий шостакович, сергей рахманинов, юрий "
    "гагарин, дмитрий менделеев, михаил ломоносов, иван павлов, константин циолковский, сергей королёв, пётр первый, иван грозный, екатерина "
    "вторая, владимир ленин, иосиф сталин, никита хрущёв, леонид брежнев, михаил горбачёв, борис ельцин, владимир путин, дмитрий медведев, михаил "
    "мишустин, сергей лавров, александр суворов, михаил кутузов, георгий жуков, илья репин, казимир малевич, василий кандинский, валентина "
    "терешкова, алексей леонов, лев ландау, андрей сахаров, игорь курчатов, николай пирогов, владимир высоцкий, виктор цой, алла пугачёва".split(", ")
)

# Countries: fixed values. The first are listed in the forms in use, the others declined by their endings.
COUNTRY_FORMS = tuple(
    "россия, россии, россию, россией, российская, рф, российская федерация, российской федерации, российской федерацией, казахстан, казахстана, казахстане, "
    "казахстаном, беларусь, беларуси, беларусью, белоруссия, белоруссии, узбекистан, узбекистана, узбекистане, таджикистан, таджикистана, таджикистане, киргизия, "
    "киргизии, кыргызстан, кыргызстана, кыргызская республика, кыргызской республики, кыргызской республикой, армения, армении, армению, азербайджан, азербайджана, "
    "азербайджане, азербайджанская республика, азербайджанской республики, азербайджанской республикой, грузия, грузии, молдова, молдовы, молдове, украина, украины, "
    "украине, туркменистан, туркменистана, вьетнам, вьетнама, вьетнаме, китай, китая, китае, кнр, китайская народная республика, китайской народной республики, корея, "
    "кореи, республика корея, республики корея, турция, турции, индия, индии, сша, германия, германии, фрг, великобритания, великобритании, великобританию, израиль, "
    "израиля, румыния, румынии, франция, франции, францию, францией, французская республика, французской республики, французской республикой, испания, испании, "
    "испанию, испанией, италия, италии, италию, италией, социалистическая республика вьетнам, социалистической республики вьетнам, azerbaijani, russian, kazakh, "
    "uzbek, tajik, armenian, georgian, moldovan, ukrainian, turkmen, vietnamese, chinese, korean, turkish, indian, german, israeli, belarusian, kyrgyz".split(", ")
)
OTHER_STATES = tuple(
    "алжир, ангола, бенин, ботсвана, буркина-фасо, бурунди, габон, гамбия, гана, гвинея, гвинея-бисау, джибути, египет, замбия, зимбабве, кабо-верде, камерун, кения, "
    "коморы, конго, демократическая республика конго, кот-д’ивуар, лесото, либерия, ливия, маврикий, мавритания, мадагаскар, малави, мали, марокко, мозамбик, намибия, "
    "нигер, нигерия, руанда, сан-томе и принсипи, эсватини, свазиленд, сейшелы, сенегал, сомали, судан, южный судан, сьерра-леоне, танзания, того, тунис, уганда, "
    "центральноафриканская республика, чад, экваториальная гвинея, эритрея, эфиопия, юар, южно-африканская республика, афганистан, бангладеш, бахрейн, бруней, бутан, "
    "восточный тимор, индонезия, иордания, ирак, иран, йемен, камбоджа, катар, кипр, кндр, кувейт, лаос, ливан, малайзия, мальдивы, монголия, мьянма, непал, оаэ, оман, "
    "пакистан, саудовская аравия, сингапур, сирия, таиланд, филиппины, шри-ланка, япония, австрия, албания, андорра, бельгия, болгария, босния и герцеговина, ватикан, "
    "венгрия, греция, дания, ирландия, исландия, латвия, литва, лихтенштейн, люксембург, мальта, монако, нидерланды, северная македония, норвегия, польша, португалия, "
    "сан-марино, сербия, словакия, словения, финляндия, хорватия, черногория, чехия, швейцария, швеция, эстония, антигуа и барбуда, аргентина, багамы, барбадос, белиз, "
    "боливия, бразилия, венесуэла, гаити, гайана, гватемала, гондурас, гренада, доминика, доминиканская республика, канада, колумбия, коста-рика, куба, мексика, "
    "никарагуа, панама, парагвай, перу, сальвадор, сент-винсент и гренадины, сент-китс и невис, сент-люсия, суринам, тринидад и тобаго, уругвай, чили, эквадор, ямайка, "
    "австралия, вануату, кирибати, маршалловы острова, микронезия, науру, новая зеландия, палау, папуа-новая гвинея, самоа, соломоновы острова, тонга, тувалу, "
    "фиджи".split(", ")
)
#: States whose names are common words too.
COMMON_WORD_STATES = frozenset("того мали чад чада гана гане гану куба кубы кубе нигер оман омана перу чили фиджи самоа тонга".split())
