"""Fixed values of the geo dimension: locale, time zone and Accept-Language of countries, time zones of cities."""

COUNTRIES = (
    ("AD", "ca-AD", "Europe/Andorra", "ca-AD,ca;q=0.9,es;q=0.8,fr;q=0.7,en;q=0.6"),
    ("AL", "sq-AL", "Europe/Tirane", "sq-AL,sq;q=0.9,en;q=0.8"),
    ("AM", "hy-AM", "Asia/Yerevan", "hy-AM,hy;q=0.9,ru;q=0.8,en;q=0.7"),
    ("AT", "de-AT", "Europe/Vienna", "de-AT,de;q=0.9,en;q=0.8"),
    ("AZ", "az-AZ", "Asia/Baku", "az-AZ,az;q=0.9,ru;q=0.8,en;q=0.7"),
    ("BA", "bs-BA", "Europe/Sarajevo", "bs-BA,bs;q=0.9,hr;q=0.8,sr;q=0.7,en;q=0.6"),
    ("BE", "nl-BE", "Europe/Brussels", "nl-BE,nl;q=0.9,fr;q=0.8,en;q=0.7"),
    ("BG", "bg-BG", "Europe/Sofia", "bg-BG,bg;q=0.9,en;q=0.8"),
    ("BY", "be-BY", "Europe/Minsk", "be-BY,be;q=0.9,ru;q=0.8,en;q=0.7"),
    ("CH", "de-CH", "Europe/Zurich", "de-CH,de;q=0.9,fr;q=0.8,it;q=0.7,en;q=0.6"),
    ("CY", "el-CY", "Asia/Nicosia", "el-CY,el;q=0.9,tr;q=0.8,en;q=0.7"),
    ("CZ", "cs-CZ", "Europe/Prague", "cs-CZ,cs;q=0.9,en;q=0.8"),
    ("DE", "de-DE", "Europe/Berlin", "de-DE,de;q=0.9,en;q=0.8"),
    ("DK", "da-DK", "Europe/Copenhagen", "da-DK,da;q=0.9,en;q=0.8"),
    ("EE", "et-EE", "Europe/Tallinn", "et-EE,et;q=0.9,ru;q=0.8,en;q=0.7"),
    ("ES", "es-ES", "Europe/Madrid", "es-ES,es;q=0.9,en;q=0.8"),
    ("FI", "fi-FI", "Europe/Helsinki", "fi-FI,fi;q=0.9,sv;q=0.8,en;q=0.7"),
    ("FO", "fo-FO", "Atlantic/Faroe", "fo-FO,fo;q=0.9,da;q=0.8,en;q=0.7"),
    ("FR", "fr-FR", "Europe/Paris", "fr-FR,fr;q=0.9,en;q=0.8"),
    ("GB", "en-GB", "Europe/London", "en-GB,en;q=0.9"),
    ("GE", "ka-GE", "Asia/Tbilisi", "ka-GE,ka;q=0.9,ru;q=0.8,en;q=0.7"),
    ("GI", "en-GI", "Europe/Gibraltar", "en-GI,en;q=0.9,es;q=0.8"),
    ("GR", "el-GR", "Europe/Athens", "el-GR,el;q=0.9,en;q=0.8"),
    ("HR", "hr-HR", "Europe/Zagreb", "hr-HR,hr;q=0.9,en;q=0.8"),
    ("HU", "hu-HU", "Europe/Budapest", "hu-HU,hu;q=0.9,en;q=0.8"),
    ("IE", "en-IE", "Europe/Dublin", "en-IE,en;q=0.9"),
    ("IS", "is-IS", "Atlantic/Reykjavik", "is-IS,is;q=0.9,en;q=0.8"),
    ("IT", "it-IT", "Europe/Rome", "it-IT,it;q=0.9,en;q=0.8"),
    ("LI", "de-LI", "Europe/Vaduz", "de-LI,de;q=0.9,en;q=0.8"),
    ("LT", "lt-LT", "Europe/Vilnius", "lt-LT,lt;q=0.9,en;q=0.8"),
    ("LU", "lb-LU", "Europe/Luxembourg", "lb-LU,lb;q=0.9,fr;q=0.8,de;q=0.7,en;q=0.6"),
    ("LV", "lv-LV", "Europe/Riga", "lv-LV,lv;q=0.9,ru;q=0.8,en;q=0.7"),
    ("MC", "fr-MC", "Europe/Monaco", "fr-MC,fr;q=0.9,en;q=0.8"),
    ("MD", "ro-MD", "Europe/Chisinau", "ro-MD,ro;q=0.9,ru;q=0.8,en;q=0.7"),
    ("ME", "sr-ME", "Europe/Podgorica", "sr-ME,sr;q=0.9,en;q=0.8"),
    ("MK", "mk-MK", "Europe/Skopje", "mk-MK,mk;q=0.9,en;q=0.8"),
    ("MT", "mt-MT", "Europe/Malta", "mt-MT,mt;q=0.9,en;q=0.8"),
    ("NL", "nl-NL", "Europe/Amsterdam", "nl-NL,nl;q=0.9,en;q=0.8"),
    ("NO", "nb-NO", "Europe/Oslo", "nb-NO,nb;q=0.9,no;q=0.8,en;q=0.7"),
    ("PL", "pl-PL", "Europe/Warsaw", "pl-PL,pl;q=0.9,en;q=0.8"),
    ("PT", "pt-PT", "Europe/Lisbon", "pt-PT,pt;q=0.9,en;q=0.8"),
    ("RO", "ro-RO", "Europe/Bucharest", "ro-RO,ro;q=0.9,en;q=0.8"),
    ("RS", "sr-RS", "Europe/Belgrade", "sr-RS,sr;q=0.9,en;q=0.8"),
    ("SE", "sv-SE", "Europe/Stockholm", "sv-SE,sv;q=0.9,en;q=0.8"),
    ("SI", "sl-SI", "Europe/Ljubljana", "sl-SI,sl;q=0.9,en;q=0.8"),
    ("SK", "sk-SK", "Europe/Bratislava", "sk-SK,sk;q=0.9,en;q=0.8"),
    ("SM", "it-SM", "Europe/San_Marino", "it-SM,it;q=0.9,en;q=0.8"),
    ("TR", "tr-TR", "Europe/Istanbul", "tr-TR,tr;q=0.9,en;q=0.8"),
    ("UA", "uk-UA", "Europe/Kyiv", "uk-UA,uk;q=0.9,ru;q=0.8,en;q=0.7"),
    ("VA", "it-VA", "Europe/Vatican", "it-VA,it;q=0.9,en;q=0.8"),
    ("BS", "en-BS", "America/Nassau", "en-BS,en;q=0.9"),
    ("BZ", "en-BZ", "America/Belize", "en-BZ,en;q=0.9,es;q=0.8"),
    ("CA", "en-CA", "America/Toronto", "en-CA,en;q=0.9,fr-CA;q=0.8,fr;q=0.7"),
    ("CR", "es-CR", "America/Costa_Rica", "es-CR,es;q=0.9,en;q=0.8"),
    ("CU", "es-CU", "America/Havana", "es-CU,es;q=0.9,en;q=0.8"),
    ("DO", "es-DO", "America/Santo_Domingo", "es-DO,es;q=0.9,en;q=0.8"),
    ("GT", "es-GT", "America/Guatemala", "es-GT,es;q=0.9,en;q=0.8"),
    ("HN", "es-HN", "America/Tegucigalpa", "es-HN,es;q=0.9,en;q=0.8"),
    ("HT", "fr-HT", "America/Port-au-Prince", "fr-HT,fr;q=0.9,en;q=0.8"),
    ("JM", "en-JM", "America/Jamaica", "en-JM,en;q=0.9"),
    ("MX", "es-MX", "America/Mexico_City", "es-MX,es;q=0.9,en;q=0.8"),
    ("NI", "es-NI", "America/Managua", "es-NI,es;q=0.9,en;q=0.8"),
    ("PA", "es-PA", "America/Panama", "es-PA,es;q=0.9,en;q=0.8"),
    ("PR", "es-PR", "America/Puerto_Rico", "es-PR,es;q=0.9,en;q=0.8"),
    ("SV", "es-SV", "America/El_Salvador", "es-SV,es;q=0.9,en;q=0.8"),
    ("TT", "en-TT", "America/Port_of_Spain", "en-TT,en;q=0.9"),
    ("US", "en-US", "America/New_York", "en-US,en;q=0.9"),
    ("AR", "es-AR", "America/Argentina/Buenos_Aires", "es-AR,es;q=0.9,en;q=0.8"),
    ("BO", "es-BO", "America/La_Paz", "es-BO,es;q=0.9,en;q=0.8"),
    ("BR", "pt-BR", "America/Sao_Paulo", "pt-BR,pt;q=0.9,en;q=0.8"),
    ("CL", "es-CL", "America/Santiago", "es-CL,es;q=0.9,en;q=0.8"),
    ("CO", "es-CO", "America/Bogota", "es-CO,es;q=0.9,en;q=0.8"),
    ("EC", "es-EC", "America/Guayaquil", "es-EC,es;q=0.9,en;q=0.8"),
    ("GY", "en-GY", "America/Guyana", "en-GY,en;q=0.9"),
    ("PE", "es-PE", "America/Lima", "es-PE,es;q=0.9,en;q=0.8"),
    ("PY", "es-PY", "America/Asuncion", "es-PY,es;q=0.9,en;q=0.8"),
    ("SR", "nl-SR", "America/Paramaribo", "nl-SR,nl;q=0.9,en;q=0.8"),
    ("UY", "es-UY", "America/Montevideo", "es-UY,es;q=0.9,en;q=0.8"),
    ("VE", "es-VE", "America/Caracas", "es-VE,es;q=0.9,en;q=0.8"),
    ("AF", "fa-AF", "Asia/Kabul", "fa-AF,fa;q=0.9,ps;q=0.8,en;q=0.7"),
    ("BD", "bn-BD", "Asia/Dhaka", "bn-BD,bn;q=0.9,en;q=0.8"),
    ("BH", "ar-BH", "Asia/Bahrain", "ar-BH,ar;q=0.9,en;q=0.8"),
    ("BN", "ms-BN", "Asia/Brunei", "ms-BN,ms;q=0.9,en;q=0.8"),
    ("BT", "dz-BT", "Asia/Thimphu", "dz-BT,dz;q=0.9,en;q=0.8"),
    ("CN", "zh-CN", "Asia/Shanghai", "zh-CN,zh;q=0.9,en;q=0.8"),
    ("HK", "zh-HK", "Asia/Hong_Kong", "zh-HK,zh;q=0.9,en;q=0.8"),
    ("ID", "id-ID", "Asia/Jakarta", "id-ID,id;q=0.9,en;q=0.8"),
    ("IN", "en-IN", "Asia/Kolkata", "en-IN,en;q=0.9,hi;q=0.8"),
    ("IQ", "ar-IQ", "Asia/Baghdad", "ar-IQ,ar;q=0.9,en;q=0.8"),
    ("IR", "fa-IR", "Asia/Tehran", "fa-IR,fa;q=0.9,en;q=0.8"),
    ("JO", "ar-JO", "Asia/Amman", "ar-JO,ar;q=0.9,en;q=0.8"),
    ("JP", "ja-JP", "Asia/Tokyo", "ja-JP,ja;q=0.9,en;q=0.8"),
    ("KG", "ky-KG", "Asia/Bishkek", "ky-KG,ky;q=0.9,ru;q=0.8,en;q=0.7"),
    ("KH", "km-KH", "Asia/Phnom_Penh", "km-KH,km;q=0.9,en;q=0.8"),
    ("KP", "ko-KP", "Asia/Pyongyang", "ko-KP,ko;q=0.9"),
    ("KR", "ko-KR", "Asia/Seoul", "ko-KR,ko;q=0.9,en;q=0.8"),
    ("KW", "ar-KW", "Asia/Kuwait", "ar-KW,ar;q=0.9,en;q=0.8"),
    ("KZ", "kk-KZ", "Asia/Almaty", "kk-KZ,kk;q=0.9,ru;q=0.8,en;q=0.7"),
    ("LA", "lo-LA", "Asia/Vientiane", "lo-LA,lo;q=0.9,en;q=0.8"),
    ("LB", "ar-LB", "Asia/Beirut", "ar-LB,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("LK", "si-LK", "Asia/Colombo", "si-LK,si;q=0.9,ta;q=0.8,en;q=0.7"),
    ("MM", "my-MM", "Asia/Yangon", "my-MM,my;q=0.9,en;q=0.8"),
    ("MN", "mn-MN", "Asia/Ulaanbaatar", "mn-MN,mn;q=0.9,en;q=0.8"),
    ("MO", "zh-MO", "Asia/Macau", "zh-MO,zh;q=0.9,pt;q=0.8,en;q=0.7"),
    ("MV", "dv-MV", "Indian/Maldives", "dv-MV,dv;q=0.9,en;q=0.8"),
    ("MY", "en-MY", "Asia/Kuala_Lumpur", "en-MY,en;q=0.9,ms;q=0.8"),
    ("NP", "ne-NP", "Asia/Kathmandu", "ne-NP,ne;q=0.9,en;q=0.8"),
    ("OM", "ar-OM", "Asia/Muscat", "ar-OM,ar;q=0.9,en;q=0.8"),
    ("PH", "en-PH", "Asia/Manila", "en-PH,en;q=0.9,fil;q=0.8"),
    ("PK", "ur-PK", "Asia/Karachi", "ur-PK,ur;q=0.9,en;q=0.8"),
    ("PS", "ar-PS", "Asia/Gaza", "ar-PS,ar;q=0.9,en;q=0.8"),
    ("QA", "ar-QA", "Asia/Qatar", "ar-QA,ar;q=0.9,en;q=0.8"),
    ("SG", "en-SG", "Asia/Singapore", "en-SG,en;q=0.9,zh;q=0.8"),
    ("SY", "ar-SY", "Asia/Damascus", "ar-SY,ar;q=0.9,en;q=0.8"),
    ("TH", "th-TH", "Asia/Bangkok", "th-TH,th;q=0.9,en;q=0.8"),
    ("TJ", "tg-TJ", "Asia/Dushanbe", "tg-TJ,tg;q=0.9,ru;q=0.8,en;q=0.7"),
    ("TM", "tk-TM", "Asia/Ashgabat", "tk-TM,tk;q=0.9,ru;q=0.8,en;q=0.7"),
    ("TW", "zh-TW", "Asia/Taipei", "zh-TW,zh;q=0.9,en;q=0.8"),
    ("UZ", "uz-UZ", "Asia/Tashkent", "uz-UZ,uz;q=0.9,ru;q=0.8,en;q=0.7"),
    ("VN", "vi-VN", "Asia/Ho_Chi_Minh", "vi-VN,vi;q=0.9,en;q=0.8"),
    ("YE", "ar-YE", "Asia/Aden", "ar-YE,ar;q=0.9,en;q=0.8"),
    ("AE", "ar-AE", "Asia/Dubai", "ar-AE,ar;q=0.9,en;q=0.8"),
    ("IL", "he-IL", "Asia/Jerusalem", "he-IL,he;q=0.9,en;q=0.8"),
    ("SA", "ar-SA", "Asia/Riyadh", "ar-SA,ar;q=0.9,en;q=0.8"),
    ("RU", "ru-RU", "Europe/Moscow", "ru-RU,ru;q=0.9,en;q=0.8"),
    ("AO", "pt-AO", "Africa/Luanda", "pt-AO,pt;q=0.9,en;q=0.8"),
    ("BF", "fr-BF", "Africa/Ouagadougou", "fr-BF,fr;q=0.9,en;q=0.8"),
    ("BI", "fr-BI", "Africa/Bujumbura", "fr-BI,fr;q=0.9,en;q=0.8"),
    ("BJ", "fr-BJ", "Africa/Porto-Novo", "fr-BJ,fr;q=0.9,en;q=0.8"),
    ("BW", "en-BW", "Africa/Gaborone", "en-BW,en;q=0.9"),
    ("CD", "fr-CD", "Africa/Kinshasa", "fr-CD,fr;q=0.9,en;q=0.8"),
    ("CF", "fr-CF", "Africa/Bangui", "fr-CF,fr;q=0.9,en;q=0.8"),
    ("CG", "fr-CG", "Africa/Brazzaville", "fr-CG,fr;q=0.9,en;q=0.8"),
    ("CI", "fr-CI", "Africa/Abidjan", "fr-CI,fr;q=0.9,en;q=0.8"),
    ("CM", "fr-CM", "Africa/Douala", "fr-CM,fr;q=0.9,en;q=0.8"),
    ("DJ", "fr-DJ", "Africa/Djibouti", "fr-DJ,fr;q=0.9,ar;q=0.8,en;q=0.7"),
    ("DZ", "ar-DZ", "Africa/Algiers", "ar-DZ,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("EG", "ar-EG", "Africa/Cairo", "ar-EG,ar;q=0.9,en;q=0.8"),
    ("ET", "am-ET", "Africa/Addis_Ababa", "am-ET,am;q=0.9,en;q=0.8"),
    ("GA", "fr-GA", "Africa/Libreville", "fr-GA,fr;q=0.9,en;q=0.8"),
    ("GH", "en-GH", "Africa/Accra", "en-GH,en;q=0.9"),
    ("GN", "fr-GN", "Africa/Conakry", "fr-GN,fr;q=0.9,en;q=0.8"),
    ("KE", "sw-KE", "Africa/Nairobi", "sw-KE,sw;q=0.9,en;q=0.8"),
    ("LY", "ar-LY", "Africa/Tripoli", "ar-LY,ar;q=0.9,en;q=0.8"),
    ("MA", "ar-MA", "Africa/Casablanca", "ar-MA,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("MG", "fr-MG", "Indian/Antananarivo", "fr-MG,fr;q=0.9,en;q=0.8"),
    ("ML", "fr-ML", "Africa/Bamako", "fr-ML,fr;q=0.9,en;q=0.8"),
    ("MU", "en-MU", "Indian/Mauritius", "en-MU,en;q=0.9,fr;q=0.8"),
    ("MW", "en-MW", "Africa/Blantyre", "en-MW,en;q=0.9"),
    ("MZ", "pt-MZ", "Africa/Maputo", "pt-MZ,pt;q=0.9,en;q=0.8"),
    ("NA", "en-NA", "Africa/Windhoek", "en-NA,en;q=0.9"),
    ("NE", "fr-NE", "Africa/Niamey", "fr-NE,fr;q=0.9,en;q=0.8"),
    ("NG", "en-NG", "Africa/Lagos", "en-NG,en;q=0.9"),
    ("RW", "rw-RW", "Africa/Kigali", "rw-RW,rw;q=0.9,fr;q=0.8,en;q=0.7"),
    ("SD", "ar-SD", "Africa/Khartoum", "ar-SD,ar;q=0.9,en;q=0.8"),
    ("SN", "fr-SN", "Africa/Dakar", "fr-SN,fr;q=0.9,en;q=0.8"),
    ("SO", "so-SO", "Africa/Mogadishu", "so-SO,so;q=0.9,ar;q=0.8,en;q=0.7"),
    ("SS", "en-SS", "Africa/Juba", "en-SS,en;q=0.9"),
    ("TG", "fr-TG", "Africa/Lome", "fr-TG,fr;q=0.9,en;q=0.8"),
    ("TN", "ar-TN", "Africa/Tunis", "ar-TN,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("TZ", "sw-TZ", "Africa/Dar_es_Salaam", "sw-TZ,sw;q=0.9,en;q=0.8"),
    ("UG", "en-UG", "Africa/Kampala", "en-UG,en;q=0.9,sw;q=0.8"),
    ("ZA", "en-ZA", "Africa/Johannesburg", "en-ZA,en;q=0.9"),
    ("ZM", "en-ZM", "Africa/Lusaka", "en-ZM,en;q=0.9"),
    ("ZW", "en-ZW", "Africa/Harare", "en-ZW,en;q=0.9"),
    ("AU", "en-AU", "Australia/Sydney", "en-AU,en;q=0.9"),
    ("FJ", "en-FJ", "Pacific/Fiji", "en-FJ,en;q=0.9"),
    ("NZ", "en-NZ", "Pacific/Auckland", "en-NZ,en;q=0.9"),
    ("PG", "en-PG", "Pacific/Port_Moresby", "en-PG,en;q=0.9"),
    ("SB", "en-SB", "Pacific/Guadalcanal", "en-SB,en;q=0.9"),
    ("VU", "bi-VU", "Pacific/Efate", "bi-VU,bi;q=0.9,en;q=0.8,fr;q=0.7"),
    ("WS", "sm-WS", "Pacific/Apia", "sm-WS,sm;q=0.9,en;q=0.8"),
    ("AX", "fi-AX", "Europe/Mariehamn", "sv-AX,sv;q=0.9,fi;q=0.8,en;q=0.7"),
    ("GG", "en-GG", "Europe/Guernsey", "en-GG,en;q=0.9"),
    ("IM", "en-IM", "Europe/Isle_of_Man", "en-IM,en;q=0.9"),
    ("JE", "en-JE", "Europe/Jersey", "en-JE,en;q=0.9"),
    ("SJ", "nb-SJ", "Arctic/Longyearbyen", "nb-SJ,nb;q=0.9,en;q=0.8"),
    ("XK", "sq-XK", "Europe/Belgrade", "sq-XK,sq;q=0.9,sr;q=0.8,en;q=0.7"),
    ("AG", "en-AG", "America/Antigua", "en-AG,en;q=0.9"),
    ("AI", "en-AI", "America/Anguilla", "en-AI,en;q=0.9"),
    ("AW", "nl-AW", "America/Aruba", "nl-AW,nl;q=0.9,en;q=0.8,es;q=0.7"),
    ("BB", "en-BB", "America/Barbados", "en-BB,en;q=0.9"),
    ("BL", "fr-BL", "America/St_Barthelemy", "fr-BL,fr;q=0.9,en;q=0.8"),
    ("BM", "en-BM", "Atlantic/Bermuda", "en-BM,en;q=0.9"),
    ("BQ", "nl-BQ", "America/Kralendijk", "nl-BQ,nl;q=0.9,en;q=0.8"),
    ("CW", "nl-CW", "America/Curacao", "nl-CW,nl;q=0.9,en;q=0.8,es;q=0.7"),
    ("DM", "en-DM", "America/Dominica", "en-DM,en;q=0.9"),
    ("FK", "en-FK", "Atlantic/Stanley", "en-FK,en;q=0.9"),
    ("GD", "en-GD", "America/Grenada", "en-GD,en;q=0.9"),
    ("GF", "fr-GF", "America/Cayenne", "fr-GF,fr;q=0.9,en;q=0.8"),
    ("GL", "kl-GL", "America/Nuuk", "kl-GL,kl;q=0.9,da;q=0.8,en;q=0.7"),
    ("GP", "fr-GP", "America/Guadeloupe", "fr-GP,fr;q=0.9,en;q=0.8"),
    ("GS", "en-GS", "Atlantic/South_Georgia", "en-GS,en;q=0.9"),
    ("KN", "en-KN", "America/St_Kitts", "en-KN,en;q=0.9"),
    ("KY", "en-KY", "America/Cayman", "en-KY,en;q=0.9"),
    ("LC", "en-LC", "America/St_Lucia", "en-LC,en;q=0.9"),
    ("MF", "fr-MF", "America/Marigot", "fr-MF,fr;q=0.9,en;q=0.8"),
    ("MQ", "fr-MQ", "America/Martinique", "fr-MQ,fr;q=0.9,en;q=0.8"),
    ("MS", "en-MS", "America/Montserrat", "en-MS,en;q=0.9"),
    ("PM", "fr-PM", "America/Miquelon", "fr-PM,fr;q=0.9,en;q=0.8"),
    ("SX", "nl-SX", "America/Lower_Princes", "nl-SX,nl;q=0.9,en;q=0.8"),
    ("TC", "en-TC", "America/Grand_Turk", "en-TC,en;q=0.9"),
    ("VC", "en-VC", "America/St_Vincent", "en-VC,en;q=0.9"),
    ("VG", "en-VG", "America/Tortola", "en-VG,en;q=0.9"),
    ("VI", "en-VI", "America/St_Thomas", "en-VI,en;q=0.9"),
    ("TL", "pt-TL", "Asia/Dili", "pt-TL,pt;q=0.9,en;q=0.8"),
    ("CV", "pt-CV", "Atlantic/Cape_Verde", "pt-CV,pt;q=0.9,en;q=0.8"),
    ("EH", "ar-EH", "Africa/El_Aaiun", "ar-EH,ar;q=0.9,es;q=0.8,fr;q=0.7"),
    ("ER", "ti-ER", "Africa/Asmara", "ti-ER,ti;q=0.9,en;q=0.8,ar;q=0.7"),
    ("GM", "en-GM", "Africa/Banjul", "en-GM,en;q=0.9"),
    ("GQ", "es-GQ", "Africa/Malabo", "es-GQ,es;q=0.9,fr;q=0.8,pt;q=0.7"),
    ("GW", "pt-GW", "Africa/Bissau", "pt-GW,pt;q=0.9,en;q=0.8"),
    ("IO", "en-IO", "Indian/Chagos", "en-IO,en;q=0.9"),
    ("KM", "ar-KM", "Indian/Comoro", "ar-KM,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("LR", "en-LR", "Africa/Monrovia", "en-LR,en;q=0.9"),
    ("LS", "en-LS", "Africa/Maseru", "en-LS,en;q=0.9"),
    ("MR", "ar-MR", "Africa/Nouakchott", "ar-MR,ar;q=0.9,fr;q=0.8,en;q=0.7"),
    ("RE", "fr-RE", "Indian/Reunion", "fr-RE,fr;q=0.9,en;q=0.8"),
    ("SC", "en-SC", "Indian/Mahe", "en-SC,en;q=0.9,fr;q=0.8"),
    ("SH", "en-SH", "Atlantic/St_Helena", "en-SH,en;q=0.9"),
    ("SL", "en-SL", "Africa/Freetown", "en-SL,en;q=0.9"),
    ("ST", "pt-ST", "Africa/Sao_Tome", "pt-ST,pt;q=0.9,en;q=0.8"),
    ("SZ", "en-SZ", "Africa/Mbabane", "en-SZ,en;q=0.9"),
    ("TD", "fr-TD", "Africa/Ndjamena", "fr-TD,fr;q=0.9,ar;q=0.8,en;q=0.7"),
    ("YT", "fr-YT", "Indian/Mayotte", "fr-YT,fr;q=0.9,en;q=0.8"),
    ("AS", "en-AS", "Pacific/Pago_Pago", "en-AS,en;q=0.9,sm;q=0.8"),
    ("CC", "en-CC", "Indian/Cocos", "en-CC,en;q=0.9"),
    ("CK", "en-CK", "Pacific/Rarotonga", "en-CK,en;q=0.9"),
    ("CX", "en-CX", "Indian/Christmas", "en-CX,en;q=0.9"),
    ("FM", "en-FM", "Pacific/Pohnpei", "en-FM,en;q=0.9"),
    ("GU", "en-GU", "Pacific/Guam", "en-GU,en;q=0.9"),
    ("KI", "en-KI", "Pacific/Tarawa", "en-KI,en;q=0.9"),
    ("MH", "en-MH", "Pacific/Majuro", "en-MH,en;q=0.9"),
    ("MP", "en-MP", "Pacific/Saipan", "en-MP,en;q=0.9"),
    ("NC", "fr-NC", "Pacific/Noumea", "fr-NC,fr;q=0.9,en;q=0.8"),
    ("NF", "en-NF", "Pacific/Norfolk", "en-NF,en;q=0.9"),
    ("NR", "en-NR", "Pacific/Nauru", "en-NR,en;q=0.9"),
    ("NU", "en-NU", "Pacific/Niue", "en-NU,en;q=0.9"),
    ("PF", "fr-PF", "Pacific/Tahiti", "fr-PF,fr;q=0.9,en;q=0.8"),
    ("PN", "en-PN", "Pacific/Pitcairn", "en-PN,en;q=0.9"),
    ("PW", "en-PW", "Pacific/Palau", "en-PW,en;q=0.9"),
    ("TK", "en-TK", "Pacific/Fakaofo", "en-TK,en;q=0.9"),
    ("TO", "en-TO", "Pacific/Tongatapu", "en-TO,en;q=0.9"),
    ("TV", "en-TV", "Pacific/Funafuti", "en-TV,en;q=0.9"),
    ("UM", "en-UM", "Pacific/Midway", "en-UM,en;q=0.9"),
    ("WF", "fr-WF", "Pacific/Wallis", "fr-WF,fr;q=0.9,en;q=0.8"),
    ("AQ", "en-AQ", "Antarctica/McMurdo", "en-AQ,en;q=0.9"),
    ("BV", "nb-BV", "UTC", "nb-BV,nb;q=0.9,en;q=0.8"),
    ("HM", "en-HM", "UTC", "en-HM,en;q=0.9"),
    ("TF", "fr-TF", "Indian/Kerguelen", "fr-TF,fr;q=0.9,en;q=0.8"),
)

CITIES = (
    ("US", "new york", "America/New_York"),
    ("US", "boston", "America/New_York"),
    ("US", "washington", "America/New_York"),
    ("US", "atlanta", "America/New_York"),
    ("US", "miami", "America/New_York"),
    ("US", "chicago", "America/Chicago"),
    ("US", "dallas", "America/Chicago"),
    ("US", "houston", "America/Chicago"),
    ("US", "denver", "America/Denver"),
    ("US", "phoenix", "America/Phoenix"),
    ("US", "salt lake city", "America/Denver"),
    ("US", "los angeles", "America/Los_Angeles"),
    ("US", "san francisco", "America/Los_Angeles"),
    ("US", "san diego", "America/Los_Angeles"),
    ("US", "seattle", "America/Los_Angeles"),
    ("US", "portland", "America/Los_Angeles"),
    ("US", "las vegas", "America/Los_Angeles"),
    ("US", "anchorage", "America/Anchorage"),
    ("US", "honolulu", "Pacific/Honolulu"),
    ("CA", "toronto", "America/Toronto"),
    ("CA", "ottawa", "America/Toronto"),
    ("CA", "montreal", "America/Montreal"),
    ("CA", "winnipeg", "America/Winnipeg"),
    ("CA", "calgary", "America/Edmonton"),
    ("CA", "edmonton", "America/Edmonton"),
    ("CA", "vancouver", "America/Vancouver"),
    ("RU", "moscow", "Europe/Moscow"),
    ("RU", "saint petersburg", "Europe/Moscow"),
    ("RU", "kazan", "Europe/Moscow"),
    ("RU", "yekaterinburg", "Asia/Yekaterinburg"),
    ("RU", "novosibirsk", "Asia/Novosibirsk"),
    ("RU", "krasnoyarsk", "Asia/Krasnoyarsk"),
    ("RU", "irkutsk", "Asia/Irkutsk"),
    ("RU", "vladivostok", "Asia/Vladivostok"),
    ("AU", "sydney", "Australia/Sydney"),
    ("AU", "melbourne", "Australia/Melbourne"),
    ("AU", "brisbane", "Australia/Brisbane"),
    ("AU", "perth", "Australia/Perth"),
    ("AU", "adelaide", "Australia/Adelaide"),
    ("BR", "sao paulo", "America/Sao_Paulo"),
    ("BR", "rio de janeiro", "America/Sao_Paulo"),
    ("BR", "brasilia", "America/Sao_Paulo"),
    ("BR", "manaus", "America/Manaus"),
    ("BR", "fortaleza", "America/Fortaleza"),
)
