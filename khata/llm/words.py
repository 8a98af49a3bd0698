"""Stop words by language: pronouns, conjunctions, prepositions, auxiliaries and common verbs, as general stop-word lists have them.

They come from such lists, not from any corpus that is judged by them. Articles and
the like, which names in lists hold as well, are left out.
"""

# Stop words.
BANGLA = """
অতএব অথচ অথবা অনুযায়ী অনেক অনেকে অন্তত অন্য অন্যান্য অবধি অবশ্য অর্থাৎ আগামী আগে আগেই আছে আজ আপনার আপনি আবার আমরা আমাকে আমাদের আমার আমি আর আরও ইত্যাদি ইহা উচিত উনি উপর উপরে এ এই এঁদের এঁরা এক একই একটি একবার একে এখন এখনও এখানে এটা
এটি এত এতে এদের এবং এবার এমন এমনকি এর এরা এল এস এসে ও ওই ওঁদের ওকে ওখানে ওদের ওর ওরা কখন কখনও কত কবে কমনে কয়েক কয়েকটি করছে করছেন করতে করবে করবেন করলে করলেন করা করাই করায় করার করি করিতে করিয়া করে করেই করেছিলেন করেছে করেছেন করেন
কাউকে কাছ কাছে কাজ কাজে কারও কারণ কি কিংবা কিছু কিছুই কিন্তু কী কে কেউ কেউই কেন কোটি কোন কোনও কোনো ক্ষেত্রে কয়েক খুব গিয়ে গিয়েছে গেছে গেল গেলে চলে চাই চান চায় চেয়ে ছাড়া ছিল ছিলেন জন জনকে জনের জন্য জন্যে জানতে জানা জানানো
জানায় জানিয়ে জানিয়েছে ঠিক তখন তত তথা তবু তবে তা তাঁকে তাঁদের তাঁর তাঁরা তাই তাও তাকে তাতে তাদের তার তারপর তারা তাহলে তাহা তিনি তিনিও তুমি তেমন তো তোমার থাকবে থাকবেন থাকা থাকায় থাকে থাকেন থেকে থেকেই থেকেও দিকে দিতে দিন দিয়ে
দিয়েছে দিয়েছেন দিলেন দু দুই দুটি দুটো দেওয়া দেওয়ার দেখতে দেখা দেখে দেন দেয় দ্বারা ধরে নয় না নাই নাকি নাগাদ নানা নিজে নিজেই নিজেদের নিজের নিতে নিয়ে নিয়েছে নেই নেওয়া পক্ষে পর পরে পরেই পরেও পর্যন্ত পাওয়া পারি পারে পারেন
পেয়ে প্রতি প্রথম প্রভৃতি প্রায় ফলে ফিরে ফের বক্তব্য বদলে বন বরং বলতে বলল বললেন বলা বলে বলেছেন বলেন বসে বহু বা বাদে বার বিনা বিভিন্ন বিশেষ বিষয়টি বেশ বেশি ব্যবহার ব্যাপারে ভাবে ভাবেই মতো মতোই মধ্যে মধ্যেই মনে মাত্র মাধ্যমে মোট
মোটেই যখন যত যতটা যথেষ্ট যদি যদিও যা যাঁর যাঁরা যাওয়া যাওয়ার যাকে যাচ্ছে যাতে যাদের যান যাবে যায় যার যারা যিনি যে যেখানে যেতে যেন যেমন রকম রয়েছে রাখা রেখে লক্ষ শুধু শুরু সঙ্গে সব সবাই সবার সমস্ত সম্প্রতি সহ সহিত সাধারণ সামনে
সুতরাং সে সেই সেখান সেখানে সেটা সেটাই সেটি স্পষ্ট হইতে হইবে হইয়া হওয়া হওয়ায় হওয়ার হচ্ছে হত হতে হতেই হন হবে হবেন হয় হয়তো হয়নি হয়ে হয়েই হয়েছিল হয়েছে হয়েছেন হল হলে হলেই হলেও হলো হাজার হিসাবে হোক
"""
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing and but if or because as until while about against between into through during before after above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than too very can will just don should now also could would may might must shall cannot however yet still even much many every either
neither one two since without within upon among around per via at by for with said says say made make take took see saw go went come came get got know think like
"""
HINDI = """
अंदर अत अपना अपनी अपने अभी आदि आप इत्यादि इन इनका इन्हीं इन्हें इस इसका इसकी इसके इसमें इसी इसे उन उनका उनकी उनके उनको उन्हीं उन्हें उस उसके उसी उसे एक एवं एस ऐसे और कई कर करता करते करना करने करें कहते कहा का काफ़ी कि कितना
किन्हें किया किर किस किसी की कुछ कुल के को कोई कौन कौनसा गया घर जब जहाँ जा जितना जिन जिन्हें जिस जिसे जीधर जैसा जैसे जो तक तब तरह तिन तिस तो था थी थे दबारा दिया दुसरा दूसरे दो द्वारा न नहीं ना निहायत नीचे ने पर पहले पूरा पे फिर
बनी बही बहुत बाद बाला बिलकुल भी भीतर मगर मानो मे में यदि यह यहाँ यही या यिह ये रखें रहा रहे लिए लिये लेकिन व वग़ैरह वर्ग वह वहाँ वहीं वाले वुह वे सकता सकते सबसे सभी साथ साबुत साभ सारा से सो संग ही हुआ हुई हुए है हैं हो होता होती
होते होना होने क्योंकि
"""
ASSAMESE = """
আৰু এই এটা এজন এক এখন কৰা কৰি কৰিছে কৰিছিল কৰিব কৰে কৰিলে হয় হৈ হৈছে হৈছিল হ'ব হব নহয় আছে আছিল নাই নে নি যে যি যাৰ যদি তেন্তে তাৰ তাত তেওঁ তেওঁৰ তেওঁলোক মই মোৰ আমি আমাৰ তুমি আপুনি ই ইয়াৰ ইয়াত সি সেই সকলো বাবে লগত লৈ পৰা
পৰ্যন্ত মাজত মাজৰ ওপৰত তলত আগতে পাছত পিছত কাৰণে কিন্তু বা অথবা কিয় কিয়নো কি কেনেকৈ কোন কেতিয়া য'ত ত'ত যেতিয়া তেতিয়া এতিয়া আজি কালি বহুত কিছু অলপ মাত্ৰ কেৱল দ্বাৰা মতে কথা বুলি কৈছে কৈছিল থাকে থকা গৈছে গৈছিল দিয়া দিছে লোৱা
লৈছে পাৰে নোৱাৰে লাগে আকৌ আন অন্য একে
"""
ROMAN_BANGLA = """
ami amar amake amra amader tumi tomar apni apnar se tar take tara tader ei oi eta ota ki keno ken kotha kothay kokhon kobe kemon kothai je jara jar jodi jokhon tokhon tobe kintu ar ba othoba ebong o na nai nei noy hoy hoye hoyeche
holo hobe chilo chil ache achen kore kori korbe korche koreche korechen koren korte kora jay jabe jacche giye giyeche theke diye niye niyeche jonno jonyo sathe songe moddhe modhye upor age pore por kache ta to ekta ek onek kichu
sob shob khub ekhon ekhane sekhane bole bolen boleche mone
"""

CLAUSE = frozenset(w for many in (BANGLA, ENGLISH, HINDI, ASSAMESE, ROMAN_BANGLA) for w in many.split())
